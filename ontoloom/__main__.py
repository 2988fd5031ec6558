"""python -m ontoloom doctor | annotate NOTES.csv ONTOLOGY.obo OUT | vectorize ONTOLOGY.obo OUT"""

from __future__ import annotations

import importlib.util
import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    verb = args[0] if args else ""
    if verb == "doctor":
        missing = [m for m in ("pyspark", "pyarrow", "pandas", "numpy") if importlib.util.find_spec(m) is None]
        print("missing: " + ", ".join(missing) if missing else "all required packages are here")
        return int(bool(missing))
    if (verb, len(args)) not in (("annotate", 4), ("vectorize", 3)):
        print(__doc__)
        return 2
    from .plans import annotate
    from .sources import obo, sinks

    spark = SparkSession.builder.getOrCreate()
    if verb == "annotate":
        results, invalid = annotate.annotate_file(spark, args[1], args[2])
        sinks.export_results(results.unionByName(invalid), args[3])
    else:
        terms = obo.terms(spark, args[1]).where("NOT obsolete")
        sinks.write_vectors(annotate.vectorize(obo.phrases(terms), terms.select("id", "label")), args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
