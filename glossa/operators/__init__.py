"""Set-oriented text operators: each takes a DataFrame of texts and gives a DataFrame of answers."""
