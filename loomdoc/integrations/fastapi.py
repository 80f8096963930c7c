"""A response class for FastAPI and Starlette."""

from __future__ import annotations

from typing import Any

from starlette.responses import JSONResponse as _JSONResponse

from loomdoc.api import dumps


class JSONResponse(_JSONResponse):
    def render(self, content: Any) -> bytes:
        return dumps(content, return_type="bytes")
