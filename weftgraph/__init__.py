"""weftgraph: code-graph, retrieval and change analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
