"""DataFrame operators: fusion, ranking, evidence, governance, timestamps."""
