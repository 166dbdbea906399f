"""Plans that combine operators, and the registered queries."""

from ridgeline.plans import catalogue, files, systems

__all__ = ["catalogue", "files", "systems"]
