"""Query text to DataFrame plans: lexer, parser, expressions, clauses."""
