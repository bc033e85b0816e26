"""Translation of values by exact or leading match."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS = object()
_KINDS = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


@dataclass
class Translation:
    """Values by key. leading: keys match the beginning of a value, the first in order wins. default: what other values
    become; without one they pass as they are."""

    pairs: dict
    leading: bool = False
    default: object = PASS
    key_type: str = "str"

    @staticmethod
    def load(path: str) -> Translation:
        """From a JSON file with translation and, optionally, keytype, leading and default."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not isinstance(spec.get("translation"), dict):
            raise ValueError(f"{path} has no translation")
        return Translation(spec["translation"], bool(spec.get("leading", False)), spec.get("default", PASS), spec.get("keytype", "str"))

    def column(self, value: Column) -> Column:
        out = F.lit(None)
        kind = _KINDS[self.key_type]
        text = value.cast("string")
        values = list(self.pairs.values())
        as_text = self.default is PASS or any(isinstance(v, str) for v in values)
        wanted = (lambda v: F.lit(str(v) if as_text and v is not None else v))
        chain = None
        for k, v in self.pairs.items():
            hit = text.startswith(str(k)) if self.leading else value.cast(kind) == F.lit(k).cast(kind)
            chain = F.when(hit, wanted(v)) if chain is None else chain.when(hit, wanted(v))
        out = text if self.default is PASS else wanted(self.default)
        return chain.otherwise(out) if chain is not None else out
