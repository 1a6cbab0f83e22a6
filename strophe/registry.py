"""Name -> query and name -> SQL for the analytics operators."""

from __future__ import annotations

from .queries import diagnosis, planning, series, signals, spectra, tables, texts

QUERIES: dict = {**series.QUERIES, **spectra.QUERIES, **tables.QUERIES, **texts.QUERIES, **planning.QUERIES, **diagnosis.QUERIES, **signals.QUERIES}
ORACLES: dict = {**series.ORACLES, **spectra.ORACLES, **tables.ORACLES, **texts.ORACLES, **planning.ORACLES, **diagnosis.ORACLES, **signals.ORACLES}
