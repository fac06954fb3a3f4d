"""Locations of genes in the cell: broad classes of location names, and the best classes of a gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first class one of whose texts a lower-cased location holds; "a&b" asks for both.
CLASSES = [
    ("mitochondria", ["mitochond", "respir"]),
    ("golgi", ["golgi"]),
    ("endosome", ["endosom"]),
    ("peroxisome", ["perox", "microbod"]),
    ("ER", ["endoplasmic reticulum", "sarcoplas", "signal recog"]),
    ("lysosome", ["lytic", "lyso"]),
    ("plasma_membrane", ["ytoplasmic side of membrane", "plasma&membrane", "lamell", "desmo", "cell-cell", "cell-substrate", "leading edge", "filopo", "focal ad", "projection", "adhere", "junction"]),
    ("nucleolus", ["nucleolus", "fibrillar"]),
    ("nucleus", ["snrnp", "repli", "splice", "replic", "kineto", "nucl", "polymerase", "chrom", "dna", "centrosome"]),
    ("endomembrane", ["endomemb", "copi", "granule"]),
    ("intracellular", ["intracell"]),
    ("ribosome", ["riboso"]),
    ("proteasome", ["aggresome", "proteasome"]),
    ("extracellular", ["exosome", "extracellular"]),
    ("cytoskeleton", ["cortex", "centrio", "myosin", "microtub", "ruffle", "cytoske", "cili", "actin", "contractile", "kinesin", "filament", "spindle"]),
    ("phagocytic", ["phago", "pino"]),
    ("organelle", ["organelle"]),
    ("vesicle", ["vesic", "vacuol"]),
    ("membrane", ["apical", "membr", "periph", "furrow", "surface"]),
    ("protein complex", ["macromol", "complex", "supramol"]),
    ("cytoplasm", ["cytoplasm", "cytosol"]),
    ("neuron", ["cell body", "ranvier", "synap", "cajal", "bouton", "neuron", "cone", "axon", "dendrit", "perik"]),
    ("muscle", ["tubule", "sarco", "zone", "fibril", "myelin", "disc", "band"]),
    ("lipoprotein", ["lipopro", "chylo"]),
]
NONSPECIFIC = ["cellular_component", "Cell", "Cell part", "Intracellular"]
NOT_ORGANELLES = ["extracellular", "organelle", "intracellular", "membrane", "cytoplasmcytoskeleton", "protein complex", "neuron", "muscle", "lipoprotein", "plasma_membrane"]
ENDOMEMBRANES = ["ER", "golgi", "endosome", "lysosome", "peroxisome", "phagocytic"]
FAVOURED = ["mitochondria", "lysosome", "peroxisome"]
UNFAVOURED = ["intracellular", "extracellular", "cytoplasm"]
LAST = ["membrane", "neuron", "muscle"]


def broad(location: Column) -> Column:
    """The broad class of a location's name; null where no rule holds, and for null."""
    low, out = F.lower(location), None
    for name, texts in CLASSES:
        hit = None
        for text in texts:
            one = None
            for word in text.split("&"):
                one = low.contains(word) if one is None else one & low.contains(word)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def best_locations(locations: DataFrame) -> DataFrame:
    """(gene, location, others): a gene's best class and the next three of those it has with confidence of 3 or more.

    locations has gene, location and confidence; unspecific locations and unknown classes don't count. Classes are
    ordered by score, ties by name. General classes go where a gene has specific ones, and some stand last. A gene
    without any has nulls.
    """
    genes = locations.select("gene").distinct()
    named = locations.where(~F.col("location").isin(NONSPECIFIC)).withColumn("k", broad(F.col("location"))).where("confidence >= 3 AND k IS NOT NULL")
    k, c = F.col("k"), F.col("confidence")
    points = (c - 2) * F.when(k.isin(FAVOURED), 1.5).otherwise(1.0) + (c == 5).cast("int") - k.isin(UNFAVOURED).cast("int")
    w = Window.partitionBy("gene")
    s = named.groupBy("gene", "k").agg(F.sum(points).alias("score"))
    s = s.withColumns({"_n": F.count("*").over(w), "_other": F.count_if(~k.isin("extracellular", "intracellular", "plasma membrane")).over(w), "_organelle": F.count_if(~k.isin(NOT_ORGANELLES)).over(w), "_endo": F.count_if(k.isin(ENDOMEMBRANES)).over(w)})
    general = (k == "intracellular") & (F.col("_other") > 0) | (k == "organelle") & (F.col("_organelle") > 0) | (k == "endomembrane") & (F.col("_endo") > 0) | (k == "vesicle") & (F.col("_endo") > 2)
    s = s.where(~(general & (F.col("_n") > 1)))
    place = F.coalesce(*(F.when(k == name, i + 1) for i, name in enumerate(LAST)), F.lit(0))
    order = s.withColumn("_i", F.row_number().over(w.orderBy(place, F.desc("score"), "k")))
    best = order.where("_i <= 4").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("_i", "k"))).alias("v"))
    return genes.join(best, "gene", "left").select("gene", F.col("v")[0]["k"].alias("location"), F.array_join(F.transform(F.slice("v", 2, 3), lambda x: x["k"]), ",").alias("others"))


def renamed(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Genes under their current symbol (aliases: alias, symbol, rank); of an alias the first one counts, and of genes that become one the one that had the name."""
    first = aliases.groupBy("alias").agg(F.min_by("symbol", F.struct("rank", "symbol")).alias("symbol")).withColumnRenamed("alias", "gene")
    both = rows.join(first, "gene", "left").withColumn("_to", F.coalesce("symbol", "gene"))
    w = Window.partitionBy("_to").orderBy((F.col("gene") == F.col("_to")).cast("int").desc(), "gene")
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").withColumn("gene", F.col("_to")).drop("symbol", "_to", "_i")
