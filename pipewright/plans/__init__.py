"""Business questions, each a function from tables (and a policy) to a DataFrame."""
