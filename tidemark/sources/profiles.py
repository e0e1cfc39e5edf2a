"""Mapping profiles: how the fields of a foreign export become normalised records. Profiles are data."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from tidemark.functions.times import LAYOUTS


class ProfileError(ValueError):
    """A profile that cannot be used."""


@dataclass(frozen=True)
class FieldMap:
    field: str = ""
    const: str = ""
    default: str = ""
    layout: str = ""


@dataclass(frozen=True)
class HeartbeatMatch:
    field: str = ""
    equals: str = ""
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Capabilities:
    sequenced: bool
    heartbeats: bool
    typed: bool
    actors: bool

    def missing(self) -> list[str]:
        out = []
        if not self.sequenced:
            out.append("sequence-gap and duplicate detection (no sequence field mapped)")
        if not self.heartbeats:
            out.append("observation-gap detection (no heartbeat marker mapped)")
        return out

    def assessed(self) -> list[str]:
        out = ["sequence-gap/duplicate"] if self.sequenced else []
        if self.heartbeats:
            out.append("observation-gap")
        return [*out, "timestamp", "coverage"]


@dataclass(frozen=True)
class Profile:
    name: str = ""
    description: str = ""
    source_id: FieldMap | None = None
    timestamp: FieldMap | None = None
    sequence: FieldMap | None = None
    actor: FieldMap | None = None
    event_type: FieldMap | None = None
    heartbeat: HeartbeatMatch | None = None

    def capabilities(self) -> Capabilities:
        return Capabilities(
            sequenced=self.sequence is not None,
            heartbeats=self.heartbeat is not None,
            typed=self.event_type is not None,
            actors=self.actor is not None,
        )

    def validate(self) -> "Profile":
        if not self.name.strip():
            raise ProfileError("profile: name is required")
        t = self.timestamp
        if t is None or (not t.field and not t.const):
            raise ProfileError(f"profile {self.name!r}: a timestamp mapping (field) is required")
        if t.layout not in LAYOUTS:
            raise ProfileError(f"profile {self.name!r}: unknown timestamp layout {t.layout!r}")
        if self.source_id is not None and not self.source_id.field and not self.source_id.const:
            raise ProfileError(f"profile {self.name!r}: source_id mapping needs field or const")
        return self


# The bundled presets, as a profile file would state them.
PRESETS = {
    "generic": Profile(
        name="generic",
        source_id=FieldMap(field="source"),
        timestamp=FieldMap(field="time", layout="rfc3339"),
        sequence=FieldMap(field="seq"),
        actor=FieldMap(field="actor"),
        event_type=FieldMap(field="type"),
        heartbeat=HeartbeatMatch(field="type", equals="heartbeat"),
    ),
    "cloudtrail": Profile(
        name="cloudtrail",
        source_id=FieldMap(field="eventSource", default="cloudtrail"),
        timestamp=FieldMap(field="eventTime", layout="rfc3339"),
        actor=FieldMap(field="userIdentity.arn"),
        event_type=FieldMap(field="eventName"),
    ),
    "idp-signin": Profile(
        name="idp-signin",
        source_id=FieldMap(const="idp/tenant-primary"),
        timestamp=FieldMap(field="createdDateTime", layout="rfc3339"),
        actor=FieldMap(field="userPrincipalName"),
        event_type=FieldMap(field="activityDisplayName", default="idp.signin"),
    ),
    "immudb-export": Profile(
        name="immudb-export",
        source_id=FieldMap(field="source", default="immudb"),
        timestamp=FieldMap(field="ts", layout="unix"),
        sequence=FieldMap(field="tx"),
        actor=FieldMap(field="actor"),
        event_type=FieldMap(field="type"),
    ),
}


def _strict(cls, raw: dict, where: str):
    known = {f.name for f in fields(cls)}
    unknown = set(raw) - known
    if unknown:
        raise ProfileError(f"{where}: unknown field {sorted(unknown)[0]!r}")
    return raw


def parse_profile(text: str) -> Profile:
    """Reads a profile file; a mistyped key is an error, not a silent no-op."""
    raw = _strict(Profile, json.loads(text), "profile")
    built = {}
    for key, value in raw.items():
        if key in ("name", "description"):
            built[key] = value
        elif value is None:
            built[key] = None
        elif key == "heartbeat":
            inner = dict(_strict(HeartbeatMatch, value, key))
            inner["types"] = tuple(inner.get("types") or ())
            built[key] = HeartbeatMatch(**inner)
        else:
            built[key] = FieldMap(**_strict(FieldMap, value, key))
    return Profile(**built).validate()


def load_profile(name_or_path: str) -> Profile:
    if not name_or_path:
        raise ProfileError("profile: empty name")
    if name_or_path.endswith(".json") or "/" in name_or_path:
        with open(name_or_path, encoding="utf-8") as handle:
            return parse_profile(handle.read())
    if name_or_path not in PRESETS:
        raise ProfileError(f"unknown profile {name_or_path!r} (neither a file nor a preset)")
    return PRESETS[name_or_path].validate()
