"""graphweft: graph embedding, graph structure and data preparation as Spark plans."""

__version__ = "0.1.0"
