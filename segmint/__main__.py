"""Command-line segmentation run: ``python -m segmint --data DIR --out DIR [options]``.

The same steps as the interactive application, without the web form: build
the wide customer row, apply the segment filters, report correlations and the
elbow curve, fit the final model and write the client table and the cluster
profile.  Every step is a Spark job; outputs are written by the executors.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

from pyspark.sql import functions as F

from segmint.functions.dates import month_end_of
from segmint.functions.prep import cap_value, flag_to_int, impute_defaults
from segmint.operators import filters as flt
from segmint.operators import model as mdl
from segmint.operators import stats as st
from segmint.operators.features import semi_join
from segmint.plans import domain as d
from segmint.plans import wide
from segmint.session import checkpoint_dir, cluster_conf, cut_lineage, get_session, scratch
from segmint.sources import catalog, sinks
from segmint.sources.readers import read_wide_csv
from segmint.sources.store import MonthStore

# The application's defaults for missing values in its input file.
APP_TEXT_FILL = {"PREF_CITY": "Undefined", "PAYROLL_TP": "Undefined", "SOC_SEG": "Undefined"}
APP_NUMBER_FILL = {"AVG_MB_IB_TRN_CNT": 0, "AVG_POS_TRN_CNT": 0, "AVG_ATM_TRN_CNT": 0, "MONTHLY_INCOME": 0}
STRICT_FLAGS = ["IS_INT_BNK_USER", "IS_MOB_BNK_USER"]


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="segmint", description=__doc__.splitlines()[0])
    p.add_argument("--data", default=None, help="folder with the source tables (Parquet)")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--model", nargs="+", default=["MONTHLY_INCOME", "AVG_MB_IB_TRN_AMT", "URGENT_AVG_AMT"])
    p.add_argument("--reporting", nargs="*", default=["REGION", "SOC_SEG"])
    p.add_argument("--k", type=int, default=17, help="final number of clusters (>= 2)")
    p.add_argument("--elbow-max", type=int, default=0, help="also sweep k = 3..N (0: skip)")
    p.add_argument("--filters", default="{}",
                   help='JSON {"ranges": {col: [lo, hi]}, "members": {col: [...]}, "panel": {col: control}}; [0, 0] and [] are off; '
                        'a control of the panel is null (untouched), [...], {"range": [lo, hi]} or a search text')
    p.add_argument("--active-only", action="store_true", help="only customers active in the last month")
    p.add_argument("--snapshot-root", default=None,
                   help="read-through store of monthly wide rows; a month is reused when it was completed "
                        "for the same source, dates and columns, built and written otherwise")
    p.add_argument("--wide-csv", default=None,
                   help="start from a wide customer table exported as CSV instead of the source tables")
    p.add_argument("--catalog", default=catalog.DEFAULT_CATALOG,
                   help="variable catalogue JSON (model_variables, reporting_variables)")
    p.add_argument("--strict", action="store_true",
                   help="previous application's rules: every filter applies (empty list: no rows), "
                        "TENURE null -> 0 and capped at 30, text flags '1' -> 1 else 0")
    p.add_argument("--as-of", default=None, help="YYYY-MM-DD or 'today': the month before it is the snapshot (default: the test tables' date)")
    p.add_argument("--event-as-of", default=None, help="the same for the event channels (default: --as-of if given)")
    p.add_argument("--seeds", type=int, nargs="+", default=[42])
    p.add_argument("--master", default=None)
    p.add_argument("--input-gb", type=float, default=None, help="size of the source tables: with --cores, sizes splits, shuffles and skew limits")
    p.add_argument("--cores", type=int, default=None, help="cores of all executors together")
    return p.parse_args(argv)


def as_date(text: str | None, default: dt.date) -> dt.date:
    if text is None:
        return default
    return dt.date.today() if text == "today" else dt.date.fromisoformat(text)


def store_params(data: str, as_of: dt.date, event_as_of: dt.date) -> dict:
    """All that a stored month depends on: source tables, both dates and the columns of the row."""
    columns = [d.KEY, *d.REPORTING_VARIABLES, *d.MODEL_VARIABLES, d.SECOND_KEY, *d.CUSTOMER_FACT, *d.SEGMENT_FACT]
    source = data if "://" in data else os.path.abspath(data)
    return {"source": source, "snapshot": str(month_end_of(as_of, 1)), "events": str(month_end_of(event_as_of, 1)), "columns": columns}


def panel_criteria(panel: dict) -> dict:
    """The form's controls from JSON: null (untouched), a list of values, {"range": [low, high]}, or a search text."""
    return {c: tuple(v["range"]) if isinstance(v, dict) else v for c, v in panel.items()}


def run(args: argparse.Namespace, spark=None) -> dict[str, str]:
    """The whole flow; its outputs are files, so everything else it wrote on the way is deleted at the end."""
    with scratch():
        return _run(args, spark)


def _run(args: argparse.Namespace, spark=None) -> dict[str, str]:
    sized = cluster_conf(int(args.input_gb * (1 << 30)), args.cores) if args.input_gb and args.cores else None
    spark = spark or get_session(args.master, extra=sized)
    checkpoint_dir(spark)
    as_of = as_date(args.as_of, d.AS_OF)
    event_as_of = as_date(args.event_as_of, as_of if args.as_of else d.EVENT_AS_OF)
    cat = catalog.load_catalog(spark, args.catalog)
    bad = [r.variable for r in catalog.unknown_selections(cat, args.model, "model").collect()]
    bad += [r.variable for r in catalog.unknown_selections(cat, args.reporting, "reporting").collect()]
    if bad:
        raise SystemExit(f"not in the variable catalogue: {bad}")
    spec = json.loads(args.filters)
    ranges = {c: tuple(v) for c, v in spec.get("ranges", {}).items()}
    if args.wide_csv:
        numeric = [r.variable for r in cat.where("role = 'model'").collect()] + list(ranges)
        source = impute_defaults(read_wide_csv(spark, args.wide_csv, numeric), APP_TEXT_FILL, APP_NUMBER_FILL)
    elif not args.data:
        raise SystemExit("give --data (source tables) or --wide-csv")
    elif args.snapshot_root:
        # The store holds the row of every customer; the activity filter comes after it.
        store, params = MonthStore(spark, args.snapshot_root), store_params(args.data, as_of, event_as_of)

        def build():
            tenure = wide.tenure_from_store(spark, args.data, store, params["source"], as_of)
            return wide.customer_wide(spark, args.data, as_of, event_as_of, active_only=False, check=True, tenure=tenure)

        source = store.read_or_build(month_end_of(as_of, 1), params, build)
        if args.active_only:
            source = semi_join(source, d.active_keys(spark, args.data, as_of), d.KEY)
    else:
        source = wide.customer_wide(spark, args.data, as_of, event_as_of, active_only=args.active_only, check=True)
    if args.strict:
        if "TENURE" in source.columns:
            source = source.withColumn("TENURE", cap_value("TENURE", 30.0))
        for flag in STRICT_FLAGS:
            if flag in source.columns:
                source = source.withColumn(flag, flag_to_int(flag))
    population = flt.filter_segment(source, ranges, spec.get("members", {}), mandatory=args.strict)
    if spec.get("panel"):
        population = flt.filter_panel(population, panel_criteria(spec["panel"]))
    population = cut_lineage(population)
    if population.isEmpty():
        raise SystemExit("no customer passes the filters")
    out = {}

    def write(name, df):
        path = os.path.join(args.out, name)
        sinks.write_profile(df, path) if name != "clients" else sinks.write_client_table(df, path)
        out[name] = path

    snap = month_end_of(as_of, 1)
    write("population", st.population_metrics(population)
          .withColumn("data_as_of", F.date_format(F.lit(snap), "yyyy-MM-dd")))
    corr = cut_lineage(st.correlation_long(population, args.model, lower_only=True, digits=None))
    write("correlation", corr.withColumn("r", st.np_round("r", 2)))
    write("redundant", st.redundant_pairs(corr, digits=2))
    if args.elbow_max >= 3:
        prepared = mdl.prepare_features(population, args.model, keep=["PERS_ID"])
        write("elbow", mdl.elbow_curve(prepared, args.model, args.elbow_max, key="PERS_ID"))
    clients, fit = mdl.segment(population, "PERS_ID", args.model, args.reporting, args.k, tuple(args.seeds))
    write("clients", clients)
    write("profile", st.profile_wide(st.profile_long(clients, args.model, "Cluster"), args.k)
          .orderBy("row_order").drop("row_order"))
    out["inertia"] = str(fit.inertia)
    return out


def main(argv=None) -> None:
    print(json.dumps(run(parse_args(argv))))


if __name__ == "__main__":
    main()
