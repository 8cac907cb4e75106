"""Device names for client addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_name_each(devices: DataFrame) -> DataFrame:
    """One row per network and address; of several names the first by alphabet.

    The set of an address's few names stays in a hash aggregate; the minimum of a string would sort
    the map.
    """
    return devices.groupBy("network_id", "ip").agg(
        F.array_min(F.collect_set("device")).alias("device")
    )


def overlay_devices(base: DataFrame, local: DataFrame) -> DataFrame:
    """Base map overlaid by a local one: the local entry wins; one name per address."""
    columns = ["network_id", "ip", "device"]
    ranked = base.select(*columns, F.lit(1).alias("_rank")).unionByName(
        local.select(*columns, F.lit(0).alias("_rank"))
    )
    return (
        ranked.groupBy("network_id", "ip")
        .agg(F.min(F.struct("_rank", "device")).alias("_first"))
        .select("network_id", "ip", "_first.device")
    )


def label_clients(
    rows: DataFrame,
    devices: DataFrame | None,
    client: str = "client",
    label: str = "device",
) -> DataFrame:
    """Add the device name of an address, or the address itself when it has none.

    Callers aggregate first, so the row side is small. An address that the map names twice has
    one label, so no row is doubled. No broadcast is forced: Spark picks
    one when the map is below its size limit and shuffles otherwise, because the map grows
    with the number of networks.
    """
    if devices is None:
        return rows.withColumn(label, F.col(client))
    names = one_name_each(devices).select(
        F.col("network_id"), F.col("ip").alias("_ip"), F.col("device").alias("_device")
    )
    joined = rows.join(
        names,
        (rows["network_id"] == names["network_id"]) & (rows[client] == names["_ip"]),
        "left",
    ).drop(names["network_id"])
    return joined.withColumn(label, F.coalesce("_device", client)).drop("_ip", "_device")
