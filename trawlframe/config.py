"""Crawl settings: defaults, environment, command line, validation."""

from __future__ import annotations

import argparse
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

#: Option, environment variable, command-line flag (fixed names).
NAMES = {
    "max_count": ("CRAWLER_MAX_COUNT", "max-count"),
    "max_concurrent": ("CRAWLER_MAX_CONCURRENT", "max-concurrent"),
    "url": ("CRAWLER_URL", "url"),
    "timeout": ("CRAWLER_TIMEOUT", "timeout"),
    "retry_attempts": ("CRAWLER_RETRY_ATTEMPTS", "retry-attempts"),
    "retry_delay": ("CRAWLER_RETRY_DELAY", "retry-delay"),
    "output_dir": ("CRAWLER_OUTPUT_DIR", "output-dir"),
    "log_level": ("CRAWLER_LOG_LEVEL", "log-level"),
    "max_file_size": ("CRAWLER_MAX_FILE_SIZE", None),
}
LOG_LEVELS = ("debug", "info", "warn", "error")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


class Duration(float):
    """Seconds, written like 1h2m3.5s."""

    @classmethod
    def parse(cls, text: str) -> Duration:
        body = text[1:] if text[:1] in "+-" else text
        if body == "0":
            return cls(0)
        found = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
        if not found or "".join(a + b for a, b in found) != body:
            raise ValueError(f"not a duration: {text!r}")
        return cls((-1 if text[0] == "-" else 1) * sum(float(a) * _UNITS[b] for a, b in found))

    def __str__(self) -> str:
        us = round(abs(self) * 1e6)
        sign = "-" if self < 0 else ""
        number = lambda x: f"{x:.6f}".rstrip("0").rstrip(".")
        if us < 1_000_000:
            return sign + ("0s" if not us else f"{us}µs" if us < 1000 else f"{number(us / 1000)}ms")
        minutes, rest = divmod(us, 60_000_000)
        hours, minutes = divmod(minutes, 60)
        return sign + (f"{hours}h" if hours else "") + (f"{minutes}m" if hours or minutes else "") + f"{number(rest / 1e6)}s"


@dataclass(frozen=True)
class CrawlConfig:
    max_count: int = 100
    max_concurrent: int = 10
    url: str = ""
    timeout: Duration = Duration(30)
    retry_attempts: int = 3
    retry_delay: Duration = Duration(1)
    output_dir: str = "./.tmp/"
    log_level: str = "info"
    max_file_size: int = 64 << 20

    def validated(self) -> CrawlConfig:
        """Itself, or ValueError. Zero attempts would mean a success without a try, so they are refused too."""
        for name, bad in (("max_count", self.max_count <= 0), ("max_concurrent", self.max_concurrent <= 0), ("url", not self.url), ("timeout", self.timeout <= 0), ("retry_attempts", self.retry_attempts < 1), ("retry_delay", self.retry_delay < 0), ("output_dir", not self.output_dir), ("log_level", self.log_level not in LOG_LEVELS)):
            if bad:
                raise ValueError(f"{NAMES[name][1]}: {getattr(self, name)!r} is not allowed")
        return self

    def __str__(self) -> str:
        shown = ["MaxCount", "MaxConcurrent", "URL", "Timeout", "RetryAttempts", "RetryDelay", "OutputDir", "LogLevel"]
        return "Config{" + ", ".join(f"{label}: {getattr(self, f.name)}" for label, f in zip(shown, fields(self))) + "}"


def load(argv: Sequence[str] = (), env: Mapping[str, str] | None = None) -> CrawlConfig:
    """Defaults, then the environment, then flags. An environment value that can't be read, or is empty, counts as unset."""
    env = os.environ if env is None else env
    config = CrawlConfig()
    parser = argparse.ArgumentParser(prog="trawlframe", allow_abbrev=False)
    for f in fields(CrawlConfig):
        kind = type(getattr(config, f.name))
        read = kind.parse if kind is Duration else kind
        variable, flag = NAMES[f.name]
        if value := env.get(variable):
            try:
                config = replace(config, **{f.name: read(value)})
            except ValueError:
                pass
        if flag:
            parser.add_argument(f"-{flag}", f"--{flag}", dest=f.name, type=read, default=None)
    given = {k: v for k, v in vars(parser.parse_args(list(argv))).items() if v is not None}
    return replace(config, **given).validated()
