"""Payment, call and data-session analytics expressed as Spark DataFrame jobs."""

from weftline.case import Case
from weftline.session import build_session

__all__ = ["Case", "build_session"]
