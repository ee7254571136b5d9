"""Path templates: %a is an application id with its UTC start, %h the host and port."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PathTemplate:
    base: str
    app: str = "app"
    host: str = "localhost"
    port: int = 0
    started: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))

    def application(self) -> str:
        day = self.started.replace(hour=0, minute=0, second=0, microsecond=0)
        millis = (self.started - day) // dt.timedelta(milliseconds=1)
        return f"{self.app}-{self.started:%y-%m-%d}-{millis:07x}"

    def node(self) -> str:
        return re.sub(r"\W", "-", f"{self.host[:18]}-{str(self.port)[:8]}")

    def expand(self, path: str) -> str:
        return path.replace("%a", self.application()).replace("%h", self.node())

    def get(self, path: str) -> str:
        return f"{self.base.rstrip('/')}/{path}"
