"""Imports every plan module, which fills the registry."""

from . import q_eval, q_models, q_retrieval, q_sets, q_sources, q_streams, q_text, q_vectors  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
