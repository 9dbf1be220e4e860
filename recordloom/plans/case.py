"""One call for a whole run: load, resolve, detect, record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import sinks
from . import catalogue, lobbying, profile, provenance


def run_case(spark: SparkSession, root: str, warehouse: str, out: str, *, profile_: profile.Profile = profile.LOBBYING,
             external: dict[str, DataFrame] | None = None, detectors=None, years=None, force: bool = False) -> DataFrame:
    """Load what is new, match registrants, run detectors, and return the provenance table.

    Results go to ``out``: one table per detector, ``resolution_*`` tables, ``_provenance`` and
    ``manifest``. ``external`` holds the registries that are not part of the profile (congress members, foreign
    agents); a detector whose tables are missing is left out of the run. ``detectors`` names the ones to run.
    """
    profile.load(spark, profile_, root, warehouse, years=years, force=force)
    tables = {**profile.open_tables(spark, profile_, warehouse), **(external or {})}
    for name, df in zip(("canonical", "queue", "report"), lobbying.resolve_registrants(tables)):
        provenance.run_with_provenance(df, f"resolution_{name}", out, text=f"resolve_registrants:{name}")
    for ident in detectors or catalogue.idents():
        try:
            catalogue.run_detector(ident, tables)
        except KeyError as missing:
            if missing.args[0] in tables or detectors:
                raise
            continue
        provenance.run_detector_with_provenance(ident, tables, out)
    ledger = sinks.read_if_there(spark, f"{warehouse}/_ledger")
    if ledger is not None:
        sinks.write_manifest(tables, ledger, f"{out}/manifest")
    return provenance.provenance_table(spark, out)
