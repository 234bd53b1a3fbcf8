"""Panel operators: cleaning, validation, reshaping."""
