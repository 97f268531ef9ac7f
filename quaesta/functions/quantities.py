"""Reading a quantity (number and unit) out of a short text, and its value in SI units."""

from __future__ import annotations

import re
from functools import lru_cache

PREFIX = {"p": 1e-12, "n": 1e-9, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "": 1.0, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
PREFIX_WORD = {"pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "deci": 1e-1, "": 1.0, "hecto": 1e2, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12}
# Symbol of each unit that takes prefixes -> SI unit, factor.
SYMBOL = {
    "C": ("C", 1), "A": ("A", 1), "V": ("V", 1), "F": ("F", 1), "Ω": ("ohm", 1), "ohm": ("ohm", 1), "ohms": ("ohm", 1), "H": ("H", 1), "J": ("J", 1), "Hz": ("Hz", 1), "s": ("s", 1), "m": ("m", 1),
    "N": ("N", 1), "W": ("W", 1), "T": ("T", 1), "g": ("kg", 1e-3), "Pa": ("Pa", 1), "K": ("K", 1), "rad": ("rad", 1), "eV": ("J", 1.602176634e-19), "cal": ("J", 4.184), "Wh": ("J", 3600), "bar": ("Pa", 1e5),
    "G": ("T", 1e-4), "t": ("kg", 1e3),
}
# Unit words (singular), all taking prefix words.
WORD = {
    "coulomb": ("C", 1), "ampere": ("A", 1), "amp": ("A", 1), "volt": ("V", 1), "farad": ("F", 1), "ohm": ("ohm", 1), "henry": ("H", 1), "joule": ("J", 1), "hertz": ("Hz", 1), "second": ("s", 1),
    "metre": ("m", 1), "meter": ("m", 1), "newton": ("N", 1), "watt": ("W", 1), "tesla": ("T", 1), "gram": ("kg", 1e-3), "gramme": ("kg", 1e-3), "pascal": ("Pa", 1), "kelvin": ("K", 1), "radian": ("rad", 1),
    "electronvolt": ("J", 1.602176634e-19), "calorie": ("J", 4.184), "gauss": ("T", 1e-4), "tonne": ("kg", 1e3), "bar": ("Pa", 1e5),
}
# Units without prefixes -> SI unit, factor, offset.
ALONE = {
    "°C": ("K", 1, 273.15), "degC": ("K", 1, 273.15), "deg C": ("K", 1, 273.15), "degrees Celsius": ("K", 1, 273.15), "degree Celsius": ("K", 1, 273.15), "Celsius": ("K", 1, 273.15), "celsius": ("K", 1, 273.15),
    "°": ("rad", 0.017453292519943295, 0), "deg": ("rad", 0.017453292519943295, 0), "degrees": ("rad", 0.017453292519943295, 0), "degree": ("rad", 0.017453292519943295, 0),
    "min": ("s", 60, 0), "mins": ("s", 60, 0), "minute": ("s", 60, 0), "minutes": ("s", 60, 0), "h": ("s", 3600, 0), "hr": ("s", 3600, 0), "hour": ("s", 3600, 0), "hours": ("s", 3600, 0), "d": ("s", 86400, 0), "day": ("s", 86400, 0), "days": ("s", 86400, 0),
    "sec": ("s", 1, 0), "secs": ("s", 1, 0), "atm": ("Pa", 101325, 0), "atmosphere": ("Pa", 101325, 0), "atmospheres": ("Pa", 101325, 0), "mmHg": ("Pa", 133.322387415, 0),
    "N/C": ("V/m", 1, 0), "litre": None, "amps": ("A", 1, 0),
}
#: Units with a scale far from one that prefixes must not reach.
_NO_PREFIX = {"K", "rad", "t", "G", "ohms", "bar", "cal"}
_EXTRA_PREFIXED = {"kcal": ("J", 4184), "mbar": ("Pa", 1e2), "kG": ("T", 0.1), "kohms": ("ohm", 1e3), "Mohms": ("ohm", 1e6)}
# Spellings of "no unit".
NO_UNIT = {"", "-", "--", "---", "–", "—", "n/a", "na", "none", "null", "nil", "nan", "unitless", "dimensionless", "no unit", "1", "/", "?"}
_SUP = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _clean_unit(u: str) -> str:
    u = u.replace("\u2126", "Ω").replace("\u00b5", "μ").replace("\u212a", "K").replace("º", "°").replace("·", "*")
    u = re.sub(r"\\(?:text|mathrm|rm|mathit|mbox)\s*\{([^{}]*)\}", r"\1", u)
    u = re.sub(r"\\Omega\b", "Ω", u)
    u = re.sub(r"\\mu\b\s*", "μ", u)
    u = re.sub(r"\^?\{?\\circ\}?\s*", "°", u)
    u = re.sub(r"\\(?:degree|deg)\b\s*", "°", u)
    u = re.sub(r"\\[,;:! ]|~|\$", " ", u)
    u = re.sub(r"[{}]", "", u)
    u = re.sub(r"\s+", " ", u).strip(" .,;()[]")
    u = re.sub(r"^([kMGmnpμ]) (?=Ω)", r"\1", u)
    u = re.sub(r"^° C$", "°C", u)
    return re.sub(r"^u(?=[A-ZΩa-z]{1,3}$)", "μ", u)


@lru_cache(maxsize=4096)
def unit(text: str) -> tuple[str, float, float] | None:
    """SI unit, factor and offset of a unit symbol or name; None if it is none."""
    u = _clean_unit(text)
    if not u:
        return None
    if u in ALONE:
        return ALONE[u]
    if u in SYMBOL:
        return (*SYMBOL[u], 0)
    if u in _EXTRA_PREFIXED:
        return (*_EXTRA_PREFIXED[u], 0)
    if u == "kg":
        return ("kg", 1, 0)
    m = re.fullmatch(r"([pnμmcdhkMGT])(.+)", u)
    if m and m[2] in SYMBOL and m[2] not in _NO_PREFIX:
        si, f = SYMBOL[m[2]]
        return (si, PREFIX[m[1]] * f, 0)
    for sep in ("/", " per "):
        a, s, b = u.partition(sep)
        if s:
            x, y = unit(a), unit(b)
            if x and y and not x[2] and not y[2]:
                si = {("V", "m"): "V/m", ("m", "s"): "m/s", ("N", "C"): "V/m"}.get((x[0], y[0]))
                return (si, x[1] / y[1], 0) if si else None
            return None
    w = u.lower().replace("-", "")
    w = {"henries": "henry"}.get(w, w)
    if w.endswith("henries"):
        w = w[:-7] + "henry"
    for p, f in PREFIX_WORD.items():
        if w.startswith(p):
            rest = w[len(p) :]
            rest = rest if rest in WORD else rest[:-1] if rest.endswith("s") else rest
            if rest in WORD:
                si, g = WORD[rest]
                return (si, f * g, 0)
    if p := re.fullmatch(r"(kilo|mega)ohms?|(kil|meg)ohms?", w):
        return ("ohm", 1e3 if w.startswith("kil") else 1e6, 0)
    return None


_MANT = r"[+\-−–]?\s?(?:\d{1,3}(?:[,\u00a0\u2009\u202f]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)"
_POW = r"(?:\s*(?:×|x|X|\*|·|⋅|\\times|\\cdot)\s*10\s*(?:\^\s*\{?\s*\(?([+\-−–]?\d+)\)?\s*\}?|([⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))|\s?[eE]\s?([+\-−–]?\d+))"
_NUM = re.compile(rf"({_MANT}){_POW}?")
_SCALE = re.compile(rf"^(?:×|x|X|\*|·|\\times)?\s*10\s*(?:\^\s*\{{?([+\-−–]?\d+)\}}?|([⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))\s*(.*)$")
_LEAD = re.compile(
    r"^(?:step\s*\d+\s*[:.)]\s*|(?:about|approximately|approx\.?|around|roughly|circa|ca\.?|nearly|khoảng|xấp xỉ)\s+|[≈~≃∼=]\s*|(?:answer|result|value|final answer)\s*[:=]\s*|\\approx\s*"
    r"|[A-Za-zα-ωΑ-Ω][\w\\α-ωΑ-Ω]{0,12}(?:_\{?\w+\}?)?(?:\s*\([^)]*\))?\s*(?:=|≈|:=)\s*|(?:the|this|its)\s+[a-zA-Z ]{2,40}?\s+(?:is|equals|was|are|becomes|reaches)\s+(?:about\s+|approximately\s+)?)",
    re.I,
)


def _number(m: str) -> float | None:
    s = re.sub(r"[\s\u00a0\u2009\u202f]", "", m).replace("−", "-").replace("–", "-")
    s = re.sub(r",(?=\d{3}(?!\d))", "", s).replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


def _value(m: re.Match) -> float | None:
    v = _number(m[1])
    e = m[2] or m[4] or (m[3] and m[3].translate(_SUP))
    if v is None or not e:
        return v
    n = int(e.replace("−", "-").replace("–", "-"))
    return float(f"{v!r}e{n}") if abs(n) < 300 and "e" not in repr(v) else v * 10.0**n if abs(n) < 300 else None


def read(text: str | None) -> tuple[float, str, str] | None:
    """(number, unit text or '', symbol before '=' or '') of a text that states one quantity; None for
    labels, ratios, prose, and texts with more than one number."""
    if not text:
        return None
    t = text.strip()
    t = re.sub(r"\\boxed\s*\{(.*)\}", r"\1", t, flags=re.S)
    t = re.sub(r"</?[A-Za-z_]+>|\*\*|\$|\\\(|\\\)|\\\[|\\\]", " ", t)
    t = re.sub(r"\\[,;:!]|\\ ", " ", t)
    t = re.sub(r"\\(?:text|mathrm|rm|mbox)\s*\{([^{}]*)\}", r" \1", t).strip()
    while len(t) > 1 and t[0] == "(" and t[-1] == ")":
        t = t[1:-1].strip()
    symbol = ""
    while m := _LEAD.match(t):
        if s := re.match(r"\s*([A-Za-zα-ωΑ-Ω]+)[\w\\]*\s*(?:\([^)]*\))?\s*[=≈]", m[0]):
            symbol = s[1].split("_")[0]
        t = t[m.end() :].strip()
    m = _NUM.match(t)
    if not m:
        return None
    v = _value(m)
    rest = t[m.end() :].strip().rstrip(".;,!").strip()
    if v is None or re.search(r"\d", re.sub(r"[⁰¹²³⁴⁵⁶⁷⁸⁹]", "", rest)) and not _SCALE.match(rest):
        return None
    if not rest:
        return (v, "", symbol)
    return (v, rest, symbol) if scaled_unit(rest) else None


@lru_cache(maxsize=4096)
def scaled_unit(text: str | None) -> tuple[str, float, float] | None:
    """Unit that may carry a power of ten of its own, as in '×10^3 Ω'."""
    if text is None or text.strip().lower() in NO_UNIT:
        return None
    m = _SCALE.match(text.strip())
    if m:
        u = unit(m[3])
        e = int((m[1] or m[2].translate(_SUP)).replace("−", "-").replace("–", "-"))
        return u and (u[0], u[1] * float(f"1e{e}"), u[2])
    return unit(text)


_ASKED = re.compile(r"(?i)(?:\b(?:give|state|express|report|write|quote|provide)\b[^.?!]{0,40}?\bin(?: units of| the unit)?\s+|\b(?:answer|result|value) in(?: units of)?\s+)([^.?!()]{1,24}?)\s*(?:[.?!)]|$)")


def asked_unit(question: str | None) -> str:
    """Unit in which a question wants its answer, '' if it names none."""
    for m in reversed(list(_ASKED.finditer(question or ""))):
        if scaled_unit(m[1]):
            return m[1]
    return ""


# SI unit of a quantity by its name; '' for those whose unit is none of the SI units used here.
QUANTITY_UNIT = {
    "charge": "C", "current": "A", "voltage": "V", "voltage drop": "V", "potential difference": "V", "potential": "V", "emf": "V", "capacitance": "F", "resistance": "ohm", "impedance": "ohm", "reactance": "ohm", "inductance": "H",
    "energy": "J", "stored energy": "J", "heat": "J", "heat released": "J", "work": "J", "frequency": "Hz", "time": "s", "period": "s", "time constant": "s", "duration": "s", "length": "m", "distance": "m", "displacement": "m", "wavelength": "m",
    "force": "N", "power": "W", "power loss": "W", "magnetic field": "T", "magnetic field strength": "T", "electric field": "V/m", "field strength": "V/m", "mass": "kg", "speed": "m/s", "velocity": "m/s", "pressure": "Pa", "temperature": "K",
    "phase angle": "rad", "angle": "rad", "momentum": "", "flux": "", "surface density": "", "efficiency": "", "gravitational field strength": "", "acceleration": "", "density": "", "volume": "", "area": "",
    "năng lượng": "J", "điện tích": "C", "cường độ dòng điện": "A", "hiệu điện thế": "V", "điện trở": "ohm", "điện dung": "F", "độ tự cảm": "H", "công suất": "W", "tần số": "Hz", "chu kỳ": "s", "quãng đường": "m", "khối lượng": "kg", "vận tốc": "m/s",
}
_NAMES = "|".join(sorted(QUANTITY_UNIT, key=len, reverse=True))
_QUANTITY = re.compile(
    rf"(?i)(?:\b(?:how (?:large|big|great|high|strong|long|much) (?:is|are|was)|what (?:is|are|was|will be)|find|determine|calculate|compute|estimate)\s+(?:(?:the|its|this|an?)\s+)?(?:(?!(?:of|in|on|at|and|or|when|if|after|per|for|to|with)\b)[\w-]+\s+){{0,2}}?|\b(?:tính|tìm|xác định)\s+)"
    rf"({_NAMES})\b(?!\s+(?:density|constant|factor|ratio|gain|coefficient|efficiency|number)\b)"
)
_RATIO = re.compile(r"(?i)\bby (?:which|what) (?:factor|ratio|percentage)\b|\bhow many times\b|\b(?:what|which) (?:ratio|fraction|percentage|factor)\b|\bratio of\b")


def asks_ratio(question: str | None) -> bool:
    """Whether a question asks for a factor or ratio, which has no unit."""
    return bool(_RATIO.search(question or ""))


def asked_kind(question: str | None) -> str:
    """SI unit of the quantity a question asks for; '' if it names none or asks for a factor or ratio."""
    m = None if asks_ratio(question) else _QUANTITY.search(question or "")
    return QUANTITY_UNIT[m[1].lower()] if m else ""


# SI unit of the quantity a symbol usually stands for.
SYMBOL_UNIT = {"I": "A", "Q": "C", "q": "C", "U": "V", "V": "V", "W": "J", "C": "F", "R": "ohm", "L": "H", "P": "W", "v": "m/s", "t": "s", "E": "V/m", "f": "Hz", "d": "m", "F": "N", "B": "T", "T": "K", "p": "Pa", "m": "kg", "phi": "rad"}


def si_text(value: float, u: tuple[str, float, float]) -> str:
    return f"{value * u[1] + u[2]:.5e}"
