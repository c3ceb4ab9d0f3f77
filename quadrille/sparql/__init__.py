"""SPARQL queries over the quad relation as DataFrame plans."""

from quadrille.sparql.evaluate import ask, construct, describe, select

__all__ = ["ask", "construct", "describe", "select"]
