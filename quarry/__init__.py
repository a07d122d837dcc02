"""quarry: recorded evidence (ledgers, texts, trees, vectors, claims) as Spark DataFrames."""
