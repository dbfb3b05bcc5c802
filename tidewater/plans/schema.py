"""Index schemas: named fields of type text or keyword, in a fixed order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from tidewater.errors import Corruption, InvalidArgument
from tidewater.functions import analysis

TYPES = ("text", "keyword")
MAX_FIELDS = 65535


@dataclass(frozen=True)
class FieldMapping:
    """boost and position_decay count in features only; a field that stores token weights takes them from <name>_weights."""

    name: str
    type: str = "text"
    analyzer: str = "standard"
    stored: bool = False
    boost: float = 1.0
    position_decay: float = 0.0
    store_token_weights: bool = False

    @property
    def analyzed_by(self) -> str:
        """The name of the field's analyzer."""
        return "keyword" if self.type == "keyword" else self.analyzer


@dataclass
class Schema:
    fields: list[FieldMapping] = field(default_factory=list)
    store_doc_quality: bool = False

    def add_field(self, mapping: FieldMapping) -> Schema:
        if not mapping.name:
            raise InvalidArgument("a field needs a name")
        if self.has(mapping.name):
            raise InvalidArgument(f"field {mapping.name} is there already")
        if mapping.type not in TYPES:
            raise InvalidArgument(f"unknown field type {mapping.type}")
        if len(self.fields) >= MAX_FIELDS:
            raise InvalidArgument("too many fields")
        self.fields.append(mapping)
        return self

    def add_text_fields(self, *names: str, stored: bool = False) -> Schema:
        for name in names:
            self.add_field(FieldMapping(name, stored=stored))
        return self

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def get(self, name: str) -> FieldMapping | None:
        return next((f for f in self.fields if f.name == name), None)

    def id_of(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    def with_id(self) -> Schema:
        """The same with the identifier field, first if it isn't there."""
        if self.has("_id"):
            return self
        return Schema([FieldMapping("_id", "keyword", "keyword", True), *self.fields], self.store_doc_quality)

    def default_field(self) -> str:
        """Where a term without a field is looked for: the first text field, else the identifier."""
        return next((f.name for f in self.fields if f.type == "text" and f.name != "_id"), "_id")

    def fingerprint(self) -> str:
        """Of all analyzers that an index of this schema may have used: the two that are built in, and those of its fields."""
        return "+".join(dict.fromkeys(analysis.find(n).fingerprint for n in ("standard", "keyword", *sorted(f.analyzed_by for f in self.fields))))

    def to_json(self) -> str:
        return json.dumps({"fields": [asdict(f) for f in self.fields], "store_doc_quality": self.store_doc_quality}, indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Schema:
        """What to_json wrote."""
        try:
            raw = json.loads(text)
            out = Schema([], bool(raw.get("store_doc_quality", False)))
            for f in raw["fields"]:
                out.add_field(FieldMapping(**f))
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise Corruption(f"schema: {e}") from e
        if not out.has("_id"):
            raise Corruption("schema: no _id")
        return out

    @staticmethod
    def from_mappings(body: dict) -> Schema:
        """From {"mappings": {name: {type, stored, boost, ...}}, "store_doc_quality": bool}: fields in the order of their names, after _id. Options of a wrong type are passed over."""
        mappings = body.get("mappings") if isinstance(body, dict) else None
        if not isinstance(mappings, dict):
            raise InvalidArgument("mappings must be an object")
        out = Schema([FieldMapping("_id", "keyword", "keyword", True)], body.get("store_doc_quality") is True)

        def option(spec: dict, name: str, kinds: tuple, default):
            value = spec.get(name)
            fits = isinstance(value, kinds) and (bool in kinds or not isinstance(value, bool))
            return value if fits else default

        for name in sorted(mappings):
            spec = mappings[name]
            if name == "_id":
                continue
            if not isinstance(spec, dict):
                raise InvalidArgument(f"the mapping of {name} must be an object")
            kind = option(spec, "type", (str,), "text")
            analyzer = "keyword" if kind == "keyword" else option(spec, "analyzer", (str,), "standard")
            out.add_field(FieldMapping(name, kind, analyzer, option(spec, "stored", (bool,), False), float(option(spec, "boost", (int, float), 1.0)), float(option(spec, "position_decay", (int, float), 0.0)), option(spec, "store_token_weights", (bool,), False)))
        return out
