"""millrace: a data-frame and analytics layer over Spark SQL."""

from .frame import Frame, frame
from .session import build_session

__all__ = ["Frame", "build_session", "frame"]
