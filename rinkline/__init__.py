"""rinkline: a Spark-native engine for sports statistics and club news."""

from rinkline.session import build_session

__all__ = ["build_session"]
