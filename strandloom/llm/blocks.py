"""The blocks of ``operators.blocks``."""

from ..operators.blocks import *  # noqa: F403
