"""aiohttp: json_response, and functions for its dumps= and loads= hooks."""

from __future__ import annotations

from functools import partial

from aiohttp import web

from loomdoc.api import dumps, loads

json_response = partial(web.json_response, dumps=dumps)
__all__ = ["dumps", "json_response", "loads"]
