"""Tensors and networks as Parquet with their indices beside them."""

from __future__ import annotations

import json
from collections.abc import Hashable

from pyspark.sql import SparkSession, functions as F

from ..index import Index
from ..plans.network import Network
from ..tensor import Tensor


def _meta(t: Tensor) -> str:
    return json.dumps({"complex": t.is_complex, "indices": [[i.id, i.dim, sorted(i.tags), i.plev] for i in t.indices]})


def _tensor(spark: SparkSession, path: str, meta: str) -> Tensor:
    about = json.loads(meta)
    indices = tuple(Index(i, d, frozenset(tags), p) for i, d, tags, p in about["indices"])
    return Tensor(spark.read.parquet(path).select(*(i.column for i in indices), *(["re", "im"] if about["complex"] else ["re"])), indices, about["complex"])


def save_tensor(path: str, name: str, t: Tensor, mode: str = "error") -> None:
    """Writes path/name/data and path/name/meta; other names at the path stay, so that this also appends to a collection."""
    t.df.write.mode(mode).parquet(f"{path}/{name}/data")
    t.spark.range(1).select(F.lit(_meta(t)).alias("meta")).write.mode(mode).parquet(f"{path}/{name}/meta")


append_tensor = save_tensor


def load_tensor(spark: SparkSession, path: str, name: str) -> Tensor:
    return _tensor(spark, f"{path}/{name}/data", spark.read.parquet(f"{path}/{name}/meta").first().meta)


def save_network(path: str, name: str, net: Network, mode: str = "error") -> None:
    """Each node as a tensor of its own; edges follow from shared indices when it is read."""
    spark = net.tensors[net.root].spark
    rows = [(k, json.dumps(n), _meta(t)) for k, (n, t) in enumerate(net.tensors.items())]
    spark.createDataFrame(rows, "k int, node string, meta string").write.mode(mode).parquet(f"{path}/{name}/nodes")
    for k, t in enumerate(net.tensors.values()):
        t.df.write.mode(mode).parquet(f"{path}/{name}/data/{k}")


append_network = save_network


def load_network(spark: SparkSession, path: str, name: str) -> Network:
    nodes: dict[Hashable, Tensor] = {}
    for r in spark.read.parquet(f"{path}/{name}/nodes").orderBy("k").collect():
        nodes[json.loads(r.node)] = _tensor(spark, f"{path}/{name}/data/{r.k}", r.meta)
    return Network(nodes)
