"""Tessella: a Spark-native semantic query engine."""

from .engine import Compiled, Engine
from .errors import FanoutError, SemanticError
from .model import Model, load

__all__ = ["Compiled", "Engine", "FanoutError", "Model", "SemanticError", "load"]
