"""Falcon's JSON media handler."""

from __future__ import annotations

import falcon.media

from loomdoc.api import dumps, loads


def json_handler() -> falcon.media.JSONHandler:
    return falcon.media.JSONHandler(dumps=lambda media: dumps(media, return_type="bytes"), loads=loads)
