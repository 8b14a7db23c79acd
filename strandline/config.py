"""Where data and results are: two paths in a YAML file."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

import yaml

DEFAULT_PATH = Path.home() / ".strandline" / "config.yaml"


@dataclass(frozen=True)
class Config:
    data_dir: Path
    results_dir: Path


def load_config(path: Path | None = None) -> Config:
    path = path or DEFAULT_PATH
    if not path.exists():
        raise FileNotFoundError(f"{path} does not exist; `strandline setup` writes it")
    raw = yaml.safe_load(path.read_text()) or {}
    if lacking := [k for k in Config.__dataclass_fields__ if k not in raw]:
        raise ValueError(f"{path} does not say {' or '.join(lacking)}")
    return Config(**{k: Path(raw[k]).expanduser() for k in Config.__dataclass_fields__})


def save_config(config: Config, path: Path | None = None) -> None:
    path = path or DEFAULT_PATH
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump({k: str(v) for k, v in asdict(config).items()}))
