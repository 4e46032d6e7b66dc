"""Settings: the environment wins over Spark's configuration, which wins over the default."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX_ENV, PREFIX_CONF = "LOOMWORK_", "spark.loomwork."
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes", "on")


def seconds(text: str | None) -> float | None:
    """A duration: a bare number is seconds, else parts such as 1m30s; None if it can't be read or isn't above zero."""
    plain = (text or "").strip()
    if re.fullmatch(r"\d+", plain):
        value = float(plain)
    elif re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+", plain):
        value = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", plain))
    else:
        return None
    return value if value > 0 else None


@dataclass
class Settings:
    enabled: bool = True
    engine: str = ""
    prompt_bytes: int = 24_000
    diff_bytes: int = 120_000
    call_seconds: float = 60.0
    parallel: int = 4
    look_back: int = 100
    injection_bytes: int = 10_000

    @classmethod
    def load(cls, spark: SparkSession | None = None, env: dict[str, str] | None = None) -> Settings:
        """Unreadable values, and sizes that aren't above zero, give way to the next source. LOOMWORK_SKIP disables in any case."""
        env = dict(os.environ) if env is None else env
        out = cls()
        for f in fields(cls):
            for raw in (env.get(PREFIX_ENV + f.name.upper()), spark.conf.get(PREFIX_CONF + f.name, None) if spark else None):
                if raw is None:
                    continue
                default = getattr(out, f.name)
                value = truthy(raw) if isinstance(default, bool) else seconds(raw) if isinstance(default, float) else raw.strip() if isinstance(default, str) else int(raw) if re.fullmatch(
                    r"\s*[1-9]\d*\s*", raw
                ) else None
                if value is not None:
                    setattr(out, f.name, value)
                    break
        if truthy(env.get(PREFIX_ENV + "SKIP")):
            out.enabled = False
        return out
