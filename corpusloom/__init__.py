"""corpusloom: code- and text-corpus analytics expressed as Spark DataFrame operators."""
