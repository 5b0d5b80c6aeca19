"""Part of the quadrille analytics engine."""
