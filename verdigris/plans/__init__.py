"""Named queries; the modules register theirs in the catalogue."""

from . import catalogue, evaluation, preparation  # noqa: F401
