"""quern: document search, link-graph, evaluation and text-processing operators as Spark plans."""
