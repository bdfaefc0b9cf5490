"""python -m corvane {foundation|grounding} {build|report} --config FILE"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from corvane.plans import foundation, grounding
from corvane.session import session
from corvane.sources import sinks
from corvane.sources.readers import Config

PLANS = {"foundation": foundation, "grounding": grounding}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane", description="Entity integration, profiling and evidence on Spark.")
    plans = out.add_subparsers(dest="plan", required=True)
    for name in PLANS:
        plan = plans.add_parser(name)
        actions = plan.add_subparsers(dest="action", required=True)
        for action in ("build", "report"):
            actions.add_parser(action).add_argument("--config", default=f"configs/{name}_config.yaml")
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    plan = PLANS[args.plan]
    spark = session()
    run = plan.build(spark, Config.load(args.config, spark=spark))
    if args.action == "build":
        print(json.dumps(plan.write(run), indent=2))
    else:
        # The report alone, from the same tables; nothing else is written.
        path = run.config.path("outputs", "report") if args.plan == "foundation" else run.config.path("paths", "report_path")
        sinks.write_markdown(plan.report(run), path)
        print(json.dumps(plan.summary(run) | {"report": path}, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
