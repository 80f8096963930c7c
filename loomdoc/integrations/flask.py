"""Flask's JSON provider: unsupported types go to Flask's own default."""

from __future__ import annotations

from typing import Any

from flask.json.provider import DefaultJSONProvider

from loomdoc.api import dumps_with_default, loads


class JSONProvider(DefaultJSONProvider):
    ensure_ascii, sort_keys, compact = False, False, True

    def dumps(self, obj: Any, **options: Any) -> str:
        default = options.pop("default", self.default)
        for name in ("separators", "indent", "sort_keys"):  # Flask's own, without effect here
            options.pop(name, None)
        if options:
            raise TypeError(f"dumps() cannot honour {', '.join(options)}")
        return dumps_with_default(obj, default, native=False)

    def loads(self, s: str | bytes) -> Any:
        return loads(s)
