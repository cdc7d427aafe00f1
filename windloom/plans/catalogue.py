"""All registered queries of the library itself, with the SQL that gives the same rows."""

from windloom.plans import definitions, evaluation, files, models, sampling, scoring, selection, stores, windows

QUERIES: dict = windows.QUERIES | scoring.QUERIES | models.QUERIES | evaluation.QUERIES | selection.QUERIES | definitions.QUERIES | stores.QUERIES | sampling.QUERIES | files.QUERIES
ORACLES: dict = windows.ORACLES | scoring.ORACLES | models.ORACLES | evaluation.ORACLES | selection.ORACLES | definitions.ORACLES | stores.ORACLES | sampling.ORACLES | files.ORACLES
