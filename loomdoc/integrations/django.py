"""An encoder for Django's JsonResponse; options that would change the text are refused."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from django.core.serializers.json import DjangoJSONEncoder

from loomdoc.api import dumps_with_default


class JSONEncoder(DjangoJSONEncoder):
    def encode(self, o: Any) -> str:
        plain = {"skipkeys": False, "allow_nan": True, "sort_keys": False, "indent": None}
        other = [k for k, v in plain.items() if getattr(self, k) != v]
        if self.indent is None and (self.item_separator, self.key_separator) not in ((", ", ": "), (",", ":")):
            other.append("separators")
        if other:
            raise TypeError(f"JSONEncoder cannot honour {', '.join(other)}")
        return dumps_with_default(o, self.default, native=False)

    def iterencode(self, o: Any, _one_shot: bool = False) -> Iterator[str]:
        yield self.encode(o)
