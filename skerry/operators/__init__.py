"""DataFrame operators: chunks, lexical and vector search, ranking, results, answers, evaluation."""
