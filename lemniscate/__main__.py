"""Command line: index formulas of a table, train vectors for them, combine indexes, search, write a run file.

    spark-submit -m lemniscate index --formulas DIR --posts PARQUET --out DIR
    spark-submit -m lemniscate train --formulas DIR --posts PARQUET --config FILE --kind slt --model DIR --out DIR
    spark-submit -m lemniscate train --subword …  (model of n-gram buckets)
    spark-submit -m lemniscate vectors --formulas DIR --posts PARQUET --model DIR --out DIR
    spark-submit -m lemniscate combine --indexes DIR,DIR,DIR --field vector --out DIR
    spark-submit -m lemniscate retrieve --index DIR --queries PARQUET --field slt_vector --run-id slt --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lemniscate.functions.vectors import added
from lemniscate.operators import formulas, subword
from lemniscate.operators.formulas import representations
from lemniscate.operators.search import knn
from lemniscate.plans.api import VECTOR_FIELDS
from lemniscate.session import session
from lemniscate.sources.readers import config, formula_files, formula_tsv, usable_formulas
from lemniscate.sources.writers import write_run


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lemniscate", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="vectors of all formulas")
    index.add_argument("--formulas", required=True, help="folder of tab-separated formula tables")
    index.add_argument("--posts", required=True, help="posts with post_id")
    index.add_argument("--dims", type=int, default=300)
    train = commands.add_parser("train", help="a vector model over one representation, and the vectors it gives")
    train.add_argument("--formulas", required=True, help="folder of tab-separated formula tables")
    train.add_argument("--posts", required=True, help="posts with post_id")
    train.add_argument("--config", help="lines of key,value: vector_size, window, epoch")
    train.add_argument("--kind", choices=sorted(formulas.MODES), default="slt")
    train.add_argument("--model", required=True, help="where the model is saved")
    train.add_argument("--subword", action="store_true", help="skip-gram over hashed n-gram buckets: knows every formula, new version at each run")
    known = commands.add_parser("vectors", help="vectors of formulas by a saved model of n-gram buckets")
    known.add_argument("--formulas", required=True, help="folder of tab-separated formula tables")
    known.add_argument("--posts", required=True, help="posts with post_id")
    known.add_argument("--model", required=True)
    combine = commands.add_parser("combine", help="sums of the vectors that all indexes have of a formula")
    combine.add_argument("--indexes", required=True, help="folders with formula_id and the field, parted by commas")
    combine.add_argument("--field", default="vector")
    retrieve = commands.add_parser("retrieve", help="rank an index for query vectors")
    retrieve.add_argument("--index", required=True)
    retrieve.add_argument("--queries", required=True, help="query_id and vector fields")
    retrieve.add_argument("--field", choices=(*VECTOR_FIELDS, "vector"), default="formula_vector")
    retrieve.add_argument("--run-id", default="1")
    retrieve.add_argument("-k", type=int, default=10)
    for p in (index, train, known, combine, retrieve):
        p.add_argument("--out", required=True)
    a = parser.parse_args(args)
    spark = session(f"lemniscate-{a.command}")
    if a.command in ("index", "train", "vectors"):
        rows = usable_formulas(formula_tsv(spark, formula_files(a.formulas)), spark.read.parquet(a.posts))
        keyed = rows.select(F.col("id").alias("formula_id"), "post_id", "formula")
    if a.command == "train":
        given = config(spark, a.config) if a.config else {}
        dims, window, rounds = given.get("vector_size", 300), given.get("window", 5), given.get("epoch", 1)
        if a.subword:
            subword_model = subword.train_formulas(keyed, a.kind, rules=subword.SubwordRules(dims=dims, window=window, rounds=rounds))
            subword_model.save(a.model)
            vectors = subword_model.formula_vectors(keyed)
        else:
            model, vectors = formulas.trained(keyed, a.kind, dims=dims, window=window, rounds=rounds)
            model.write().overwrite().save(a.model)
        vectors.write.mode("overwrite").parquet(a.out)
    elif a.command == "vectors":
        subword.load(spark, a.model).formula_vectors(keyed).write.mode("overwrite").parquet(a.out)
    elif a.command == "combine":
        parts = [spark.read.parquet(x).select("formula_id", F.col(a.field).alias(f"v{n}")) for n, x in enumerate(a.indexes.split(","))]
        both = parts[0]
        for x in parts[1:]:
            both = both.join(x, "formula_id")
        total = added(*[F.col(f"v{n}") for n in range(len(parts))])
        both.select("formula_id", total.alias(a.field)).write.mode("overwrite").parquet(a.out)
    elif a.command == "index":
        vectors = representations(keyed, "formula_id", a.dims)
        keyed.select("formula_id", "post_id").distinct().join(vectors, "formula_id").write.mode("overwrite").parquet(a.out)
    else:
        collection = spark.read.parquet(a.index).select(F.col("formula_id").alias("id"), F.col(a.field).alias("vector"))
        asked = spark.read.parquet(a.queries).select("query_id", F.col(a.field).alias("vector"))
        write_run(knn(collection, asked, a.k, rescale=False), a.out, a.run_id)


if __name__ == "__main__":
    main()
