"""Registered queries: every operator on the driver tables, with an independent SQL oracle."""

from catalog.base import ORACLES, QUERIES  # noqa: F401
from catalog import bars, backtests, live, optimise, portfolios, signals, spectra, views  # noqa: F401
