"""Every query of the library, registered."""

from . import backtest, contracts, evaluation, fitted, ingest, league, ledger, linking, logs, markets, models, players, ranking, resolution, simulation, squads, streams, text, value, views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
