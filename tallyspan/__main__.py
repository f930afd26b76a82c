"""python -m tallyspan fit|validate POINTS SEGMENTS PURITY [OUTPUT], or verify OUTPUT: exit 0, or 1 with a message."""

import argparse
import json
import sys


def main(argv=None) -> int:
    from pyspark.sql import SparkSession

    from tallyspan import api

    parser = argparse.ArgumentParser("tallyspan")
    parser.add_argument("what", choices=("fit", "validate", "verify"))
    parser.add_argument("paths", nargs="+", help="points, segments, purity and, to fit, output; to verify, the output")
    parser.add_argument("--most", type=int, default=10)
    parser.add_argument("--clusters", type=int)
    parser.add_argument("--subsample-size", type=int, help="fit partitions to samples of so many rows")
    for name, kind, default in (("replicates", int, 1), ("seed", int, 0), ("window-size", float, 0.05), ("overlap", float, 0.0), ("sample-id", str, "sample"), ("assembly", str, "unspecified"), ("device", str, "auto")):
        parser.add_argument(f"--{name}", type=kind, default=default)
    a = parser.parse_args(argv)
    needed = {"fit": 4, "validate": 3, "verify": 1}[a.what]
    spark = SparkSession.builder.appName("tallyspan").getOrCreate()
    try:
        if len(a.paths) != needed:
            raise ValueError(f"{a.what} needs {needed} paths")
        if a.what == "fit":
            config = api.FitConfig(a.most, a.clusters, a.sample_id, a.assembly, a.device, a.subsample_size, a.replicates, a.seed, a.window_size, a.overlap)
            print(json.dumps(api.fit(spark, *a.paths, config=config)))
        elif a.what == "validate":
            print(json.dumps(api.validate_inputs(spark, *a.paths)))
        else:
            found = api.verify(spark, *a.paths)
            print(json.dumps(found))
            if any(found.values()):
                raise RuntimeError("the run breaks rules")
    except (ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
