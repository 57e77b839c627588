"""One query for each operator on the volumes of plans.volumes, with its equivalent in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import components as C
from ..operators import contours as K
from ..operators import neighbourhood as N
from ..operators import pins as P
from ..operators import relabel as R
from ..operators import selection as S
from ..operators import structure as U
from ..session import stored
from ..sources import remote, stream
from ..volume import LabelVolume, full
from .volumes import cte, volume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(source: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Register f(volume) -> DataFrame under its name. sql reads the common table v."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(volume(spark, sf_dir, source))
        if sql is not None:
            ORACLES[f.__name__] = f"with {'recursive ' * recursive}{cte(source)}{', ' * bool(ctes)}{ctes} {sql}"
        return f

    return add


# ---- dictionary and selection


@query("v_evt", "select distinct label from v")
def labels(v):
    return S.labels(v)


@query("v_blk", "select distinct label from v where z >= 2 and z < 7")
def labels_for_z_range(v):
    return S.labels_for_z_range(v, 2, 7)


@query("v_evt", "select count(distinct label) num_labels from v")
def num_labels(v):
    return S.num_labels(v)


@query("v_blk", "select cast(a.label as bigint) label, a.label in (select label from v) found from (values (0), (11), (13), (50), (51), (1000000)) a(label)")
def contains(v):
    return S.contains(v, [0, 11, 13, 50, 51, 1_000_000])


@query("v_blk", "select distinct label from v where label >= 12 and label < 30")
def contains_range(v):
    return S.contains_range(v, 12, 30)


@query("v_evt", "select min(label) min_label, max(label) max_label from v")
def min_max(v):
    return S.min_max(v)


@query("v_blk", "select coalesce(min(z), -1) z0, coalesce(max(z) + 1, -1) z1 from v where label = 17")
def z_range_for_label(v):
    return S.z_range_for_label(v, 17)


@query("v_evt", "select coalesce(min(x + 40 * (y + 25 * z)), -1) \"first\", coalesce(max(x + 40 * (y + 25 * z)), -1) \"last\" from v where label = 3")
def index_range(v):
    return S.index_range(v.voxels.select((F.col("x") + 40 * (F.col("y") + 25 * F.col("z"))).alias("idx"), F.col("label").alias("value")), 3)


@query("v_ord", "select x, y, z, label = 1 mask from v")
def binary_image(v):
    return S.binary_image(v, 1)


@query("v_blk", "select x, y, z, label = 20 mask from v where z >= (select min(z) from v where label = 20) and z <= (select max(z) from v where label = 20)")
def binary_image_crop(v):
    return S.binary_image(v, 20, crop=True)


@query("v_blk", "select x, y, z - 1 z, label from v where z >= 1 and z < 6")
def decompress_range(v):
    return S.z_slab(v, 1, 6).voxels


@query("v_emb", "select x, y, cast(0 as bigint) z, label from v where z = 3")
def remote_slice(v):
    return S.cutout(v, (..., 3)).voxels


@query("v_emb", "select (x - 3) // 2 x, y - 10 y, z - 1 z, label from v where x >= 3 and x < 64 and (x - 3) % 2 = 0 and y >= 10 and y < 40 and z >= 1 and z < 9")
def cutout(v):
    return S.cutout(v, (slice(3, None, 2), slice(10, -10), slice(1, 9))).voxels


@query("v_emb", "select x, y, z, case when x >= 5 and x < 25 and y >= 2 and y < 12 and z >= 1 and z < 4 then x - 5 + 100 else label end label from v")
def assign_cutout(v):
    part = S.cutout(v, (slice(5, 25), slice(2, 12), slice(1, 4)))
    return S.assign(v, (slice(5, 25), slice(2, 12), slice(1, 4)), part.with_label(F.col("x") + 100)).voxels


@query("v_blk", "select label segment, x - min(x) over w x, y - min(y) over w y, z - min(z) over w z from v window w as (partition by label)")
def each(v):
    return S.each(v)


@query("v_evt", "select (row_number() over (order by label) - 1) // 255 batch, (row_number() over (order by label) - 1) % 255 + 1 temp, label from (select distinct label from v)")
def each_multi(v):
    return S.each_multi(v)


@query("v_blk", "select cast(max(x) + 1 as integer) sx, cast(max(y) + 1 as integer) sy, cast(max(z) + 1 as integer) sz, 4 data_width, count(*) size, 4 * count(*) nbytes, true fortran_order from v")
def metadata(v):
    return v.meta()


QUERIES["full_volume"] = lambda spark, sf_dir: full(spark, (7, 5, 3), 9).voxels
ORACLES["full_volume"] = "select cast(i % 7 as bigint) x, cast(i // 7 % 5 as bigint) y, cast(i // 35 as bigint) z, cast(9 as bigint) label from range(105) t(i)"


# ---- aggregates

COUNTS = "select label, count(*) voxel_count from v group by label"


@query("v_blk", COUNTS)
def voxel_counts(v):
    return A.voxel_counts(v)


@query("v_blk", COUNTS.replace("group", "where label = 23 group"))
def voxel_count_of_label(v):
    return A.voxel_counts(v, 23)


@query("v_evt", "select label, cast(sum(x) as double) / count(*) cx, cast(sum(y) as double) / count(*) cy, cast(sum(z) as double) / count(*) cz from v group by label")
def centroids(v):
    return A.centroids(v)


@query("v_evt", "select label, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z from v group by label")
def bounding_boxes(v):
    return A.bounding_boxes(v)


@query("v_blk", "select label, min(x) min_x, min(y) min_y, min(z) min_z, max(x) + 1 max_x, max(y) + 1 max_y, max(z) + 1 max_z from v group by label")
def bounding_boxes_half_open(v):
    return A.bounding_boxes(v, half_open=True)


@query("v_blk", "select label, count(*) voxel_count, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z from v group by label")
def label_stats(v):
    return A.label_stats(v)


@query("v_evt", "select max(label) max_label, case when max(label) < 256 then 1 when max(label) < 65536 then 2 when max(label) < 4294967296 then 4 else 8 end width from v")
def stored_width(v):
    return A.stored_width(v)


@query("v_blk", "select cast(sum(case when label = pl then 1 else 0 end) as bigint) pairs from (select label, lag(label) over (order by z, y, x) pl from v)")
def pixel_pairs(v):
    return A.pixel_pairs(v)


RUNS = """select z, y, min(x) x0, max(x) x1, label from (select x, y, z, label, sum(st) over (partition by z, y order by x) g
 from (select x, y, z, label, case when label = lag(label) over (partition by z, y order by x) then 0 else 1 end st from v)) group by z, y, g, label"""


@query("v_blk", RUNS)
def runs(v):
    return A.runs(v)


@query("v_blk", "select label, count(*) voxel_count, cast(sum(x) as double) / count(*) cx, cast(sum(y) as double) / count(*) cy, cast(sum(z) as double) / count(*) cz from v group by label")
def counts_of_runs(v):
    return A.counts_of_runs(A.runs(v))


@query("v_blk", """select x, y, min(z) z0, max(z) - min(z) depth, label from (select x, y, z, label, sum(st) over (partition by x, y order by z) g
 from (select x, y, z, label, case when label = lag(label) over (partition by x, y order by z) then 0 else 1 end st from v)) group by x, y, g, label""")
def pin_columns(v):
    return A.z_columns(v)


# ---- neighbourhoods

NEXT = """nb as (select label l, lead(label) over (partition by y, z order by x) nx, lead(label) over (partition by x, z order by y) ny,
 lead(label) over (partition by x, y order by z) nz from v)"""
CONTACTS = """select least(l, m) label_a, greatest(l, m) label_b, cast(sum(fx) as bigint) fx, cast(sum(fy) as bigint) fy, cast(sum(fz) as bigint) fz,
 cast(sum(fx) as bigint) * {0} + cast(sum(fy) as bigint) * {1} + cast(sum(fz) as bigint) * {2} area
 from (select l, nx m, 1 fx, 0 fy, 0 fz from nb union all select l, ny, 0, 1, 0 from nb union all select l, nz, 0, 0, 1 from nb)
 where m is not null and l <> m and l <> 0 and m <> 0 group by least(l, m), greatest(l, m)"""


@query("v_blk", CONTACTS.format(*["cast(1 as double)"] * 3), NEXT)
def contacts(v):
    return N.contacts(v)


@query("v_evt", CONTACTS.format("cast(160 as double)", "cast(160 as double)", "cast(16 as double)"), NEXT)
def contacts_anisotropic(v):
    return N.contacts(v, (4, 4, 40))


def vcg_sql(axes: str) -> str:
    bits, w = [], {"x": "y, z", "y": "x, z", "z": "x, y"}
    for i, a in enumerate(axes):
        for j, f in enumerate(("lead", "lag")):
            bits.append(f"case when coalesce({f}(label) over (partition by {w[a]} order by {a}), label) = label then {1 << (2 * i + j)} else 0 end")
    return f"select x, y, z, cast({' + '.join(bits)} as bigint) vcg from v"


@query("v_blk", vcg_sql("xyz"))
def voxel_connectivity_graph(v):
    return N.voxel_connectivity_graph(v, 6)


@query("v_ord", vcg_sql("xy"))
def voxel_connectivity_graph_4(v):
    return N.voxel_connectivity_graph(v, 4)


@query("v_ord", f"select * from ({vcg_sql('xy')}) where z = 0")
def slice_connectivity_graph(v):
    return N.voxel_connectivity_graph(S.z_slab(v, 0, 1), 4)


@query("v_evt", """select ox x, oy y, z, case when b is null or c is null then a when a = b or a = c then a when b = c then b else d end label
 from (select x // 2 ox, y // 2 oy, z, max(case when x % 2 = 0 and y % 2 = 0 then label end) a, max(case when x % 2 = 1 and y % 2 = 0 then label end) b,
 max(case when x % 2 = 0 and y % 2 = 1 then label end) c, max(case when x % 2 = 1 and y % 2 = 1 then label end) d from v group by x // 2, y // 2, z)""")
def mode_pooling(v):
    return N.mode_pooling(v).voxels


CLOUD = """select a.label, a.x, a.y, a.z from v a join v b on b.z = a.z and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1
 and b.label = a.label {} group by a.label, a.x, a.y, a.z having count(*) < 9"""


@query("v_blk", CLOUD.format("where a.label <> 0"))
def point_cloud(v):
    return N.point_cloud(v)


@query("v_blk", CLOUD.format("where a.label = 0"))
def point_cloud_of_label(v):
    return N.point_cloud(v, 0)


@query("v_blk", CLOUD.format(""))
def contour_voxels(v):
    """The voxels that contours pass."""
    p = F.col("pixel")
    at = K.contours(v).select("label", "z", F.explode("pixels").alias("pixel")).distinct()
    return at.select("label", (p % 50).alias("x"), F.expr("pixel div 50").alias("y"), "z")


# ---- components

# Runs, edges between runs that touch, every run that each run reaches, and for each run the smallest of these as its component's root.
REACH = """r as (select *, (z * 30 + y) * 50 + x0 id from ({runs})),
 e as (select a.id i, b.id j from r a join r b on {touch}),
 reach(i, m) as (select id, id from r union select reach.i, e.j from reach join e on e.i = reach.m),
 k as (select r.*, root from r join (select i, min(m) root from reach group by i) m on m.i = r.id),
 c as (select *, dense_rank() over (partition by z order by root) - 1 ccid, dense_rank() over (order by root) cc from k)"""
IN_SLICE = "a.label = b.label and a.z = b.z and abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1"
IN_SPACE = "a.label = b.label and a.label <> 0 and abs(a.z - b.z) + abs(a.y - b.y) = 1 and a.x0 <= b.x1 and b.x0 <= a.x1"
IN_SPACE_26 = "a.label = b.label and a.label <> 0 and abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and a.id <> b.id and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1"
ON_RUN = "on c.z = v.z and c.y = v.y and v.x between c.x0 and c.x1"


def reach(touch: str, source: str = "v") -> dict:
    return {"ctes": REACH.format(runs=RUNS.replace("from v)", f"from {source})"), touch=touch).replace("from k)", f"from k{' where label <> 0' * ('label <> 0' in touch)})"), "recursive": True}


CCID = f"select v.x, v.y, v.z, c.ccid from v join c {ON_RUN}"
CC = f"select v.x, v.y, v.z, coalesce(c.cc, 0) label from v left join c {ON_RUN}"
COMPONENTS = "select z, max(ccid) + 1 components from c group by z"

@query("v_blk", CCID, **reach(IN_SLICE))
def slice_components(v):
    return C.slice_components(v)


@query("v_blk", "select z, ccid, any_value(label) label, cast(sum(x1 - x0 + 1) as bigint) voxel_count, min(y * 50 + x0) first_idx from c group by z, ccid", **reach(IN_SLICE))
def component_table(v):
    return C.component_table(v)


@query("v_ord", COMPONENTS, **reach(IN_SLICE))
def component_counts(v):
    return C.component_counts(v)


@query("v_ord", COMPONENTS, **reach(IN_SLICE))
def outer_contours(v):
    """Each component has one contour around it."""
    return K.contours(v).where("outer").groupBy("z").agg(F.count("*").alias("components"))


@query("v_blk", f"select v.x, v.y, v.z, c.cc - 1 cc from v join c {ON_RUN}", **reach(IN_SLICE))
def layer_components(v):
    return C.layer_components(v)


@query("v_blk", CCID, **reach(IN_SLICE))
def graph_components(v):
    return C.graph_components(N.voxel_connectivity_graph(v, 4))


@query("v_blk", CC, **reach(IN_SPACE_26))
def connected_components_26(v):
    return C.connected_components(v, 26)[0].voxels


@query("v_blk", CC, **reach(IN_SPACE))
def connected_components_6(v):
    return C.connected_components(v, 6)[0].voxels


@query("v_blk", "select cc, any_value(label) label from c group by cc", **reach(IN_SPACE))
def connected_components_map(v):
    return C.connected_components(v, 6)[1]


@query("v_ord", CC, **reach(IN_SPACE, "(select x, y, z, case when label = 0 then 0 else 1 end label from v)"))
def connected_components_binary(v):
    return C.connected_components(v, 6, binary_image=True)[0].voxels


@query("v_blk")
def pins(v):
    return P.pins(v)


@query("v_blk", "select cast(z as bigint) z, ccid, any_value(label) label from c group by z, ccid", **reach(IN_SLICE))
def pins_meet_all_components(v):
    """The components that the pins meet, in slabs of four slices: all of them."""
    return P.met_components(v, P.pins(v, slab=4))


@query("v_blk", "select count(*) outside from v where false")
def pins_stay_in_their_label(v):
    """Voxels of pins that have another label: none."""
    at = P.pins(v).select(F.col("label").alias("pin"), "x", "y", F.explode(F.sequence("z0", F.col("z0") + F.col("depth"))).alias("z"))
    return at.join(v.voxels, ["x", "y", "z"], "left").where("label is null or pin <> label").agg(F.count("*").alias("outside"))


@query("v_blk")
def pin_background(v):
    return P.background(P.pins(v))


# ---- relabelling


@query("v_blk", "select x, y, z, case label when 11 then 70000 when 12 then 0 when 0 then 12 else label end label from v")
def remap_preserving(v):
    return R.remap(v, {11: 70_000, 12: 0, 0: 12, 10**9: 1}, preserve_missing_labels=True).voxels


@query("v_ord", "select x, y, z, cast(case label when 0 then 5 when 1 then 5 else 1 end as bigint) label from v")
def remap(v):
    return R.remap(v, {0: 5, 1: 5, 2: 1}).voxels


@query("v_evt", "select x, y, z, case when label in (1, 2, 3, 50) then 7 else label end label from v")
def mask(v):
    return R.mask(v, [1, 2, 3, 50], 7).voxels


@query("v_evt", "select x, y, z, case when label in (1, 2, 3, 50) then label else 0 end label from v")
def mask_except(v):
    return R.mask_except(v, [1, 2, 3, 50]).voxels


@query("v_blk", "select x, y, z, dense_rank() over (order by label) + 4 label from v")
def renumber(v):
    return R.renumber(v, 5)[0].voxels


@query("v_blk", "select label, row_number() over (order by label) - 1 new_label from (select distinct label from v)")
def renumber_mapping(v):
    return R.renumbering(v)


@query("v_evt", "select case when max(label) < 256 then 1 when max(label) < 65536 then 2 else 4 end data_width, cast(count(*) * case when max(label) < 256 then 1 when max(label) < 65536 then 2 else 4 end as bigint) nbytes from v")
def refit(v):
    return R.refit(v).meta().select("data_width", "nbytes")


@query("v_evt", "select x, y, z, (label * 100) % 256 label from v")
def astype(v):
    return R.astype(R.multiply_scalar(v, 100), 1).voxels


@query("v_evt", "select x, y, z, label + 70000 label from v")
def add_scalar(v):
    return R.add_scalar(v, 70_000).voxels


@query("v_evt", "select x, y, z, label + 9 - 9 label from v")
def subtract_scalar(v):
    return R.subtract_scalar(R.add_scalar(v, 9), 9).voxels


@query("v_evt", "select x, y, z, label * 3 label from v")
def multiply_scalar(v):
    return R.multiply_scalar(v, 3).voxels


@query("v_evt", "select x, y, z, label // 7 label from v")
def floordiv_scalar(v):
    return R.floordiv_scalar(v, 7).voxels


@query("v_evt", "select x, y, z, cast(floor(label / 2.5::double) as bigint) label from v")
def truediv_scalar(v):
    return R.truediv_scalar(v, 2.5).voxels


@query("v_evt", "select x, y, z, label * label % 10 label from v")
def operator(v):
    return R.operator(v, lambda c: c * c % 10).voxels


# ---- structure


@query("v_blk", "select x, y, z, label from v union all select x, y, z + (select max(z) + 1 from v), label + 1 from v")
def zstack(v):
    return U.zstack([v, None, R.add_scalar(v, 1)]).voxels


@query("v_emb", "select case when z < 4 then 0 when z = 4 then 1 else 2 end part, x, y, case when z < 4 then z when z = 4 then 0 else z - 5 end z, label from v")
def zsplit(v):
    a, b, c = (p.voxels.select(F.lit(i).alias("part"), "x", "y", "z", "label") for i, p in enumerate(U.zsplit(v, 4)))
    return a.unionByName(b).unionByName(c)


@query("v_emb", "select z slice, x, y, cast(0 as bigint) z, label from v")
def zshatter(v):
    return U.zshatter(v)


@query("v_evt", "select x, y, z, label label_a, label + 1 label_b from v where label = 5")
def differences(v):
    return U.differences(v, R.remap(v, {5: 6}, preserve_missing_labels=True))


@query("v_blk", "select true equal_self, false equal_other, true same_structure, false equal_number")
def equality(v: LabelVolume):
    other = R.add_scalar(v, 1)
    row = (U.array_equal(v, v), U.array_equal(v, other), U.structure_equal(v, other), U.array_equal(v, 0))
    return v.spark.createDataFrame([row], "equal_self boolean, equal_other boolean, same_structure boolean, equal_number boolean")


# ---- runs as storage: the same questions, asked of runs


def as_runs(v: LabelVolume) -> LabelVolume:
    return A.as_runs(v)


@query("v_blk", "select label, count(*) voxel_count, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z from v group by label")
def label_stats_of_runs(v):
    return A.label_stats(as_runs(v))


@query("v_evt", "select label, cast(sum(x) as double) / count(*) cx, cast(sum(y) as double) / count(*) cy, cast(sum(z) as double) / count(*) cz from v group by label")
def centroids_of_runs(v):
    return A.centroids(as_runs(v))


@query("v_blk", RUNS.replace("from v)", "from (select x, y, z, case when label in (11, 13) then 12 else label end label from v))"))
def remap_of_runs(v):
    """Neighbours that become equal are joined."""
    return A.runs(R.remap(as_runs(v), {11: 12, 13: 12}, preserve_missing_labels=True))


@query("v_blk", "select cast(sum(case when label = pl then 1 else 0 end) as bigint) pairs from (select label, lag(label) over (order by z, y, x) pl from v)")
def pixel_pairs_of_runs(v):
    return A.pixel_pairs(as_runs(v))


@query("v_blk", CC, **reach(IN_SPACE_26))
def connected_components_of_runs(v):
    return C.connected_components(as_runs(v), 26)[0].voxels


# ---- the stream


def coded(v: LabelVolume, **options) -> LabelVolume:
    """A volume after compression and decompression."""
    return stream.decompress(v.spark, stream.compress(v, **options))


@query("v_blk", "select * from v")
def compress_decompress(v):
    return coded(v).voxels


@query("v_ord", "select * from v")
def compress_decompress_noise(v):
    return coded(v, context_order=3).voxels


@query("v_blk", "select * from v")
def compress_decompress_pins(v):
    return coded(v, pins=True, context_order=2).voxels


@query("v_blk", "select x, y, z - 2 z, label from v where z >= 2 and z < 5")
def decompress_range_of_stream(v):
    return stream.decompress(v.spark, stream.compress(v), 2, 5).voxels


@query("v_blk", "select * from v")
def reencode(v):
    return stream.decompress(v.spark, stream.reencode(v.spark, stream.compress(v), 4)).voxels


@query("v_blk", COMPONENTS, **reach(IN_SLICE, "(select x, y, z, case when label in (11, 13) then 12 else label end label from v)"))
def recompress(v):
    """A stream whose labels were merged in its dictionary has boundaries inside of a label; recompressed to pins, it has the components of the merged labels."""
    s = stream.Stream.parse(stream.compress(v))
    h, d = s.header, s.dictionary().copy()
    at = s.labels.index(d.tobytes())
    d[(d == 11) | (d == 13)] = 12
    merged = replace(s, labels=s.labels[:at] + d.tobytes() + s.labels[at + len(d.tobytes()) :]).to_bytes()
    counts, _ = stream.Stream.parse(stream.recompress(v.spark, merged, pins=True)).per_slice()
    assert h.label_format == stream.FLAT
    return v.spark.createDataFrame(list(enumerate(counts.tolist())), "z long, components long")


@query("v_ord", "select x, y, z, label from v")
def block_table(v):
    """A volume as a table of self-contained slices and back; no stream is put together."""
    return stream.from_blocks(stored(stream.block_table(v, context_order=2), "blocks")).voxels


@query("v_blk", "select x - 10 x, y, z - 2 z, label from v where x >= 10 and z >= 2 and z < 4")
def remote_cutout(v):
    """A cut-out of a stream read by byte ranges."""
    return remote.rload(v.spark, stream.compress(v))[10:, :, 2:4].voxels


@query("v_blk", "select distinct label from v")
def labels_of_stream(v):
    return v.spark.createDataFrame([(int(x),) for x in remote.rload(v.spark, stream.compress(v)).labels()], "label long")


@query("v_blk", "select * from (values ('sound', true, true, true, ''), ('a slice damaged', true, true, true, '1'), ('the labels damaged', true, true, false, '')) a(stream, header, crack_index, labels, bad_slices)")
def check_report(v):
    """A sound stream and two damaged ones; slices are checked on the executors."""
    raw = stream.compress(v, context_order=1)
    s = stream.Stream.parse(raw)
    labels = s.header.n_bytes + 4 * (s.header.sz + 1)
    code = labels + len(s.labels) + len(s.model) + len(s.codes[0]) + len(s.codes[1]) // 2
    rows = []
    for name, at in (("sound", None), ("a slice damaged", code), ("the labels damaged", labels + 12)):
        bad = raw if at is None else raw[:at] + bytes([raw[at] ^ 64]) + raw[at + 1 :]
        r = stream.check(bad, v.spark)
        rows.append((name, r["header"], r["crack_index"], r["labels"], ",".join(map(str, r["bad_z"]))))
    return v.spark.createDataFrame(rows, "stream string, header boolean, crack_index boolean, labels boolean, bad_slices string")


@query("v_blk", "select cast(z as bigint) z, max(ccid) + 1 components from c group by z", **reach(IN_SLICE))
def component_lengths_of_stream(v):
    counts, _ = stream.Stream.parse(stream.compress(v)).per_slice()
    return v.spark.createDataFrame(list(enumerate(counts.tolist())), "z long, components long")


@query("v_blk")
def stream_sections(v):
    return stream.section_table(v.spark, stream.compress(v, pins=True))


@query("v_ord")
def context_histogram(v):
    """context, code, n: how often each difference of codes follows the last two."""
    return stream.context_counts(stream.planned(v, 0)[1], 2)
