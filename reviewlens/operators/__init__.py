"""DataFrame -> DataFrame operators: prep, features, sentiment, tokens, EDA, metrics."""
