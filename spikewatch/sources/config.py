"""Job configuration (S2, S3): a YAML file with a ``dataset`` section (name,
format, delimiter, header) and a ``variables`` section of column roles
(``time_variable``, ``metric_variable``, ``test_variable`` flags; other keys
are documentation).  PyYAML is optional: without it, pass the same structure
as a dict."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping, Optional, Union

from ..spec import AnalysisSpec, spec_from_roles


@dataclass(frozen=True)
class SourceConfig:
    name: str = "data"
    format: str = "csv"
    options: Mapping[str, Any] = field(default_factory=dict)


def load_config(cfg: Union[str, Mapping[str, Any]], desc_cols: Optional[Mapping[str, str]] = None,
                **spec_kw) -> tuple[SourceConfig, AnalysisSpec]:
    """Parse a config (a YAML path or an already loaded dict) into reader
    settings and an ``AnalysisSpec``.  CSV sources get ``header`` and
    ``delimiter`` options and schema inference, like the reference's reader."""
    if isinstance(cfg, str):
        try:
            import yaml
        except ImportError as ex:  # pragma: no cover - depends on the image
            raise RuntimeError("reading a YAML config needs PyYAML; pass a dict instead") from ex
        with open(cfg, encoding="utf-8") as fh:
            cfg = yaml.safe_load(fh)
    ds = dict(cfg.get("dataset") or {})
    fmt = str(ds.get("format", "csv")).lower()
    opts: dict[str, Any] = {}
    if fmt == "csv":
        opts = {"header": bool(ds.get("header", True)), "delimiter": ds.get("delimiter", ","),
                "inferSchema": True}
    source = SourceConfig(name=str(ds.get("name", "data")), format=fmt, options=opts)
    spec = spec_from_roles(cfg.get("variables") or {}, desc_cols=dict(desc_cols or {}), **spec_kw)
    return source, spec
