"""Web-page entity analytics over a whole corpus, as Spark DataFrame operators."""

from pagequarry.session import session

__all__ = ["session"]
