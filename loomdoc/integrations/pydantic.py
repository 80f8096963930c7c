"""Pydantic models, alone or inside other data, as their own dumps write them."""

from __future__ import annotations

from typing import Any

import pydantic
import pydantic_core

from loomdoc.api import dumps_with_default


def default(obj: Any) -> Any:
    return obj.model_dump(mode="json") if isinstance(obj, pydantic.BaseModel) else pydantic_core.to_jsonable_python(obj, by_alias=False)


def dumps(obj: Any, *, return_type: str = "str") -> str | bytes:
    return dumps_with_default(obj, default, return_type=return_type, native=False)
