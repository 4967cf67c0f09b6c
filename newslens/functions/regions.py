"""Region names, editorial order and the line shown for a region without notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region ids and their labels, in editorial order.
REGION_LABELS: dict[str, str] = {
    "north_america": "América del Norte",
    "latin_america": "América Latina",
    "europe": "Europa",
    "east_asia": "Asia Oriental",
    "eurasia": "Eurasia",
    "middle_east": "Medio Oriente",
    "africa": "África",
    "oceania": "Oceanía",
}
REGION_ORDER = list(REGION_LABELS)
EMPTY_REGION = "Sin novedades relevantes hoy."


def label_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in REGION_LABELS.items() for x in pair])


def region_label(region: Column) -> Column:
    """Readable name of a region id; an unknown id stays as it is."""
    return F.coalesce(F.try_element_at(label_map(), region), region)


def region_rank(region: Column) -> Column:
    """Position in the editorial order, from 1; unknown regions come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in REGION_ORDER]), region).cast("int")
    return F.when(at == 0, F.lit(len(REGION_ORDER) + 1)).otherwise(at)


def is_low(configured: Column, responded: Column) -> Column:
    """Fewer than half of the region's outlets answered."""
    return (configured > 0) & (responded * 2 < configured)


def empty_region_text(configured: Column, responded: Column) -> Column:
    """What a region without notes says: no news, or how thin its coverage was."""
    thin = F.format_string("Cobertura insuficiente hoy (%d de %d medios respondieron).", responded, configured)
    return F.when(is_low(configured, responded), thin).otherwise(F.lit(EMPTY_REGION))
