"""Settings from the environment, and logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class SettingsError(ValueError):
    """A variable can't be read."""


def _flag(name: str, default: bool) -> bool:
    text = os.environ.get(name, "").strip().lower()
    if not text:
        return default
    if text in TRUE + FALSE:
        return text in TRUE
    raise SettingsError(f"{name} must be one of {', '.join(TRUE + FALSE)}")


def _count(name: str, default: int) -> int:
    text = os.environ.get(name, "").strip()
    if not text:
        return default
    if not text.isdigit() or int(text) < 1:
        raise SettingsError(f"{name} must be a positive integer")
    return int(text)


@dataclass(frozen=True)
class Settings:
    """Where data and artifacts lie, and how a local session is made. A cluster's own configuration comes before these."""

    data_dir: str = "data"
    artifacts_dir: str = "experiments"
    registry_dir: str = "registry"
    shuffle_partitions: int = 8
    log_level: str = "INFO"
    debug: bool = False

    @classmethod
    def from_environment(cls) -> Settings:
        base = cls()
        return cls(
            os.environ.get("VOLTRACE_DATA_DIR", base.data_dir), os.environ.get("VOLTRACE_ARTIFACTS_DIR", base.artifacts_dir), os.environ.get("VOLTRACE_REGISTRY_DIR", base.registry_dir),
            _count("VOLTRACE_SHUFFLE_PARTITIONS", base.shuffle_partitions), os.environ.get("VOLTRACE_LOG_LEVEL", base.log_level).upper(), _flag("VOLTRACE_DEBUG", base.debug))

    def ensure_directories(self) -> None:
        for path in (self.data_dir, self.artifacts_dir, self.registry_dir):
            os.makedirs(path, exist_ok=True)


def configure_logging(settings: Settings) -> logging.Logger:
    logger = logging.getLogger("voltrace")
    logger.setLevel("DEBUG" if settings.debug else settings.log_level)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    return logger
