"""lamina: DataFrame operators for long structured documents and training corpora."""
