"""Changes to keyed tables, a batch of rows at a time: folders that carry their members, deletes that cascade, new orders.

Each function takes tables and change rows and gives tables anew, by joins on the keys. All changes of a batch see
the tables as they were before it; of two changes of one key the one with the larger `seq` holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scoring import blank_to_null, stripped


def last_of(changes: DataFrame, *key: str) -> DataFrame:
    """One change for each key: the last."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("c")).select(*key, "c.*")


def merge(target: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """target with the rows of changes (its columns, `deleted` and `seq`) in place of those with their keys, or without them."""
    last = last_of(changes, key)
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(last.where(~F.coalesce("deleted", F.lit(False))).select(*target.columns))


def folders_after(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, name, old_name, deleted) of all folders after a batch of (seq, op, id, name); op is create, rename or delete.

    Names lose blanks at their ends; a blank name and an id without a folder change nothing. A folder is created only where no
    folder has the name after the batch; ids follow the largest, by name. A deleted folder isn't renamed.
    """
    named = changes.withColumn("name", stripped(F.coalesce("name", F.lit(""))))
    renamed = last_of(named.where("op = 'rename' and name <> ''").select("id", "seq", "name"), "id").select("id", F.col("name").alias("new_name"))
    gone = changes.where("op = 'delete'").select("id").distinct().withColumn("deleted", F.lit(True))
    kept = folders.join(renamed, "id", "left").join(gone, "id", "left")
    deleted = F.coalesce("deleted", F.lit(False))
    old = kept.select("id", F.when(deleted, F.col("name")).otherwise(F.coalesce("new_name", "name")).alias("name"), F.col("name").alias("old_name"), deleted.alias("deleted"))
    asked = named.where("op = 'create' and name <> ''").select("name").distinct()
    fresh = asked.join(old.where("not deleted").select("name"), "name", "left_anti")
    # numbered in one task: rows are folders that people name in one batch
    number = F.row_number().over(Window.orderBy("name"))
    top = folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = fresh.crossJoin(F.broadcast(top)).select((F.col("top") + number).cast("long").alias("id"), "name", F.lit(None).cast("string").alias("old_name"), F.lit(False).alias("deleted"))
    return old.unionByName(new)


def folder_changes(folders: DataFrame, members: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """folders (id, name) and members (any columns with id and folder) after a batch; members follow their folder's name and
    are loose (null) once it is deleted. op move sets the folder of the member `id` to `name`, blank for none, after the others.
    """
    after = folders_after(folders, changes)
    told = after.where("old_name is not null and (deleted or name <> old_name)")
    # folders may share a name: the one with the smallest id decides
    tags = told.groupBy(F.col("old_name").alias("folder")).agg(F.min_by(F.struct(F.when(~F.col("deleted"), F.col("name")).alias("name")), "id").alias("to"))
    moved = last_of(changes.where("op = 'move'").select("id", "seq", "name"), "id").select("id", F.struct(blank_to_null(stripped(F.coalesce("name", F.lit("")))).alias("name")).alias("moved"))
    own = members.join(tags, "folder", "left").join(moved, "id", "left")
    folder = F.when(F.col("moved").isNotNull(), F.col("moved.name")).when(F.col("to").isNotNull(), F.col("to.name")).otherwise(F.col("folder"))
    return after.where("not deleted").select("id", "name"), own.withColumn("folder", folder).select(*members.columns)


def without(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """parents without those of ids, and each table of children (table, its column with the parent's id) without theirs."""
    gone = ids.select("id").distinct()
    left = {name: table.join(gone.select(F.col("id").alias(fk)), fk, "left_anti").select(*table.columns) for name, (table, fk) in children.items()}
    return parents.join(gone, "id", "left_anti").select(*parents.columns), left


def reordered(beats: DataFrame, lists: DataFrame) -> DataFrame:
    """beats with order_index from their place in their ticket's list (ticket_id, ids); ids of other tickets and unknown ones are
    passed over, an id told twice takes its last place, and beats that no list names keep theirs."""
    places = lists.select("ticket_id", F.posexplode("ids").alias("place", "id")).groupBy("ticket_id", "id").agg(F.max("place").alias("place"))
    return beats.join(places, ["ticket_id", "id"], "left").withColumn("order_index", F.coalesce(F.col("place").cast("long"), F.col("order_index"))).select(*beats.columns)
