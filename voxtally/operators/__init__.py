"""DataFrame-in, DataFrame-out operators. None of them knows where its input came from."""
