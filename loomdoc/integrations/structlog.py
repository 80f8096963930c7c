"""A serializer for structlog's JSONRenderer, which hands over its fallback as default."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from loomdoc.api import dumps_with_default


def dumps(event: Any, *, default: Callable[[Any], Any]) -> str:
    return dumps_with_default(event, default, native=False)
