"""Which metadata a saved crop keeps: ``tags`` is a map from names such as ``0th.Orientation`` to bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segment holds so many bytes with its length; a longer maker note can't be written.
SEGMENT = 65_535
_OVERHEAD = 2


def kept(tags: Column, width: Column, height: Column) -> Column:
    """The tags without orientation, thumbnail, second image and overlong maker note, with the crop's own size."""

    def stays(name: Column, value: Column) -> Column:
        gone = name.isin("0th.Orientation", "thumbnail") | name.startswith("1st.") | name.isin("Exif.PixelXDimension", "Exif.PixelYDimension")
        return ~gone & ~((name == "Exif.MakerNote") & (F.length(value) + _OVERHEAD > SEGMENT))

    size = F.create_map(F.lit("Exif.PixelXDimension"), width.cast("string").cast("binary"), F.lit("Exif.PixelYDimension"), height.cast("string").cast("binary"))
    return F.map_concat(F.map_filter(F.coalesce(tags, F.expr("map()").cast("map<string,binary>")), stays), size)
