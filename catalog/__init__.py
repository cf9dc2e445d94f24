"""Registered queries by area; ``load`` fills the registry."""

from importlib import import_module

AREAS = ("detection", "transform", "audit", "conversations", "streams")


def load() -> None:
    for area in AREAS:
        import_module(f"catalog.{area}")
