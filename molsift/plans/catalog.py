"""Imports every plan module so that its queries register."""

from . import evaluation, fragments, models, molecules, screening, streaming  # noqa: F401
