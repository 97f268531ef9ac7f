"""SQL of the llm queries. None of these operators can be written in SQL (trained model, tokenizer,
differencing, automaton); their tests are held-out accuracy, exact round trips and brute force."""

SQL: dict[str, str] = {}
