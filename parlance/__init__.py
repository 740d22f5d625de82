"""parlance: message-corpus analytics as Spark DataFrame transformations."""

from parlance.session import get_session

__all__ = ["get_session"]
