"""The pipeline's configuration: frozen, and the same after a round trip through plain values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class PipelineConfig:
    repos: tuple[str, ...] = ()
    feeds: tuple[str, ...] = ()
    profile: tuple[str, ...] = ()
    code_host_token: str = ""
    tracker_token: str = ""
    model_base: str = ""
    model_token: str = ""
    model_name: str = ""
    config_version: str = ""
    per_source: int = 10
    remembered_ids: int = 2000
    ner_pass: float = 0.85
    ner_ignore: float = 0.6
    total_sources: int = 3

    def with_added(self, field: str, value: str) -> PipelineConfig:
        """One more repository, feed or profile line; a blank one is an error."""
        if not value.strip():
            raise ValueError(f"{field}: a blank value")
        return replace(self, **{field: (*getattr(self, field), value.strip())})

    def with_value(self, field: str, value: str) -> PipelineConfig:
        """The last value of a single field counts."""
        return replace(self, **{field: value.strip()})

    @property
    def relevance_profile(self) -> str:
        return "\n".join(self.profile)

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict) -> PipelineConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def credential(vault: Mapping[str, object], name: str) -> str:
    """The token that a vault has under a name; '' where it has none, which turns off what needs it."""
    token = vault.get(name.strip()) if name.strip() else None
    return token if isinstance(token, str) else ""
