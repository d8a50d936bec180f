"""Graph and retrieval operators; one function per operator, each DataFrame in, DataFrame out."""
