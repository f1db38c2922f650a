"""tagloom: bulk text labelling as Spark DataFrame operators."""

from .session import prepare
from .spec import PromptSpec

__all__ = ["PromptSpec", "prepare"]
