"""Typed settings from properties and command line arguments."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class FlowConfig:
    partitions: int = 30
    debounce_ms: int = 300
    batch_run: int = 1 << 16
    absent: str = "zero"
    newline: str = "spark"
    split_bytes: int = 32 << 20
    prefix: str = "keyflow"

    def with_properties(self, properties: dict[str, str]) -> "FlowConfig":
        """Fields from `prefix.name` entries; numerals may have `_` and `,`."""
        out = {}
        for f in fields(self):
            if (raw := properties.get(f"{self.prefix}.{f.name}")) is not None:
                out[f.name] = parse(raw, type(getattr(self, f.name)))
        return replace(self, **out)

    def with_arguments(self, args: list[str]) -> tuple["FlowConfig", list[str]]:
        """Fields from `--name value` pairs, and the other arguments."""
        out, rest, names = {}, [], {f.name: type(getattr(self, f.name)) for f in fields(self)}
        queue = list(args)
        while queue:
            a = queue.pop(0)
            name = a[2:].replace("-", "_") if a.startswith("--") else None
            if name in names and queue:
                out[name] = parse(queue.pop(0), names[name])
            else:
                rest.append(a)
        return replace(self, **out), rest

    def changed(self) -> dict:
        """The fields that differ from their defaults."""
        plain = type(self)()
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != getattr(plain, f.name)}


def parse(raw: str, kind: type):
    if kind is bool:
        return raw.strip().lower() == "true"
    if kind in (int, float):
        return kind(raw.replace("_", "").replace(",", "").strip())
    return raw
