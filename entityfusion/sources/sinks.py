"""Where results go."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame


def write_json(payloads: DataFrame, path: str) -> None:
    """One JSON object a line, written in parallel."""
    payloads.select("payload").write.mode("overwrite").text(path)


def write_single_json(payloads: DataFrame, path: str, most: int = 10_000) -> None:
    """One indented file: an object if there is one record, else a list. For small results; more than ``most`` records are refused."""
    rows = payloads.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; use write_json")
    made = [json.loads(r["payload"]) for r in rows]
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(made[0] if len(made) == 1 else made, indent=2, ensure_ascii=False), encoding="utf-8")


def summary_text(summary: DataFrame) -> str:
    """The console summary's line."""
    r = summary.first()
    return f"candidates: {r['candidates']}, mean confidence: {r['mean_confidence'] or 0:.3f}, errors: {r['errors']}, warnings: {r['warnings']}"


class RunFilter(logging.Filter):
    """Gives each log record the id of the run that it belongs to."""

    def __init__(self, run_id: str):
        super().__init__()
        self.run_id = run_id

    def filter(self, record: logging.LogRecord) -> bool:
        record.run_id = self.run_id
        return True


def configure_logging(path: str, run_id: str, level: int = logging.INFO) -> logging.Logger:
    """The package's logger, writing to a file and to the standard error stream, each line with the run's id. Handlers of an earlier call go."""
    logger = logging.getLogger("entityfusion")
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(run_id)s] %(name)s: %(message)s"))
        handler.addFilter(RunFilter(run_id))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
