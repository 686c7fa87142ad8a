"""The records of Parquet's Thrift definition (public format specification). Fixed values.

One line each: name, then id:field:type; `!` marks a required field, [x] a list of x."""

from __future__ import annotations

from dataclasses import dataclass

DEFINITION = """
FileMetaData 1:version:int! 2:schema:[SchemaElement]! 3:num_rows:int! 4:row_groups:[RowGroup]! 5:key_value_metadata:[KeyValue] 6:created_by:str 7:column_orders:[ColumnOrder] 8:encryption_algorithm:Empty 9:footer_signing_key_metadata:bytes
SchemaElement 1:type:int 2:type_length:int 3:repetition_type:int 4:name:str! 5:num_children:int 6:converted_type:int 7:scale:int 8:precision:int 9:field_id:int 10:logical_type:LogicalType
LogicalType 1:STRING:Empty 2:MAP:Empty 3:LIST:Empty 4:ENUM:Empty 5:DECIMAL:DecimalType 6:DATE:Empty 7:TIME:TimeType 8:TIMESTAMP:TimeType 10:INTEGER:IntType 11:UNKNOWN:Empty 12:JSON:Empty 13:BSON:Empty 14:UUID:Empty 15:FLOAT16:Empty 16:VARIANT:VariantType 17:GEOMETRY:GeometryType 18:GEOGRAPHY:GeographyType
Empty
DecimalType 1:scale:int! 2:precision:int!
TimeType 1:is_adjusted_to_utc:bool! 2:unit:TimeUnit!
TimeUnit 1:MILLIS:Empty 2:MICROS:Empty 3:NANOS:Empty
IntType 1:bit_width:int! 2:is_signed:bool!
VariantType 1:specification_version:int
GeometryType 1:crs:str
GeographyType 1:crs:str 2:algorithm:int
ColumnOrder 1:TYPE_ORDER:Empty
KeyValue 1:key:str! 2:value:bytes
RowGroup 1:columns:[ColumnChunk]! 2:total_byte_size:int! 3:num_rows:int! 4:sorting_columns:[SortingColumn] 5:file_offset:int 6:total_compressed_size:int 7:ordinal:int
SortingColumn 1:column_idx:int! 2:descending:bool! 3:nulls_first:bool!
ColumnChunk 1:file_path:str 2:file_offset:int! 3:meta_data:ColumnMetaData 4:offset_index_offset:int 5:offset_index_length:int 6:column_index_offset:int 7:column_index_length:int 8:crypto_metadata:Empty 9:encrypted_column_metadata:bytes
ColumnMetaData 1:type:int! 2:encodings:[int]! 3:path_in_schema:[str]! 4:codec:int! 5:num_values:int! 6:total_uncompressed_size:int! 7:total_compressed_size:int! 8:key_value_metadata:[KeyValue] 9:data_page_offset:int! 10:index_page_offset:int 11:dictionary_page_offset:int 12:statistics:Statistics 13:encoding_stats:[PageEncodingStats] 14:bloom_filter_offset:int 15:bloom_filter_length:int 16:size_statistics:SizeStatistics 17:geospatial_statistics:GeospatialStatistics
Statistics 1:max:bytes 2:min:bytes 3:null_count:int 4:distinct_count:int 5:max_value:bytes 6:min_value:bytes 7:is_max_value_exact:bool 8:is_min_value_exact:bool
SizeStatistics 1:unencoded_byte_array_data_bytes:int 2:repetition_level_histogram:[int] 3:definition_level_histogram:[int]
GeospatialStatistics 1:bbox:BoundingBox 2:geospatial_types:[int]
BoundingBox 1:xmin:double! 2:xmax:double! 3:ymin:double! 4:ymax:double! 5:zmin:double 6:zmax:double 7:mmin:double 8:mmax:double
PageEncodingStats 1:page_type:int! 2:encoding:int! 3:count:int!
PageHeader 1:type:int! 2:uncompressed_page_size:int! 3:compressed_page_size:int! 4:crc:int 5:data_page_header:DataPageHeader 6:index_page_header:Empty 7:dictionary_page_header:DictionaryPageHeader 8:data_page_header_v2:DataPageHeaderV2
DataPageHeader 1:num_values:int! 2:encoding:int! 3:definition_level_encoding:int! 4:repetition_level_encoding:int! 5:statistics:Statistics
DictionaryPageHeader 1:num_values:int! 2:encoding:int! 3:is_sorted:bool
DataPageHeaderV2 1:num_values:int! 2:num_nulls:int! 3:num_rows:int! 4:encoding:int! 5:definition_levels_byte_length:int! 6:repetition_levels_byte_length:int! 7:is_compressed:bool 8:statistics:Statistics
OffsetIndex 1:page_locations:[PageLocation]! 2:unencoded_byte_array_data_bytes:[int]
PageLocation 1:offset:int! 2:compressed_page_size:int! 3:first_row_index:int!
ColumnIndex 1:null_pages:[bool]! 2:min_values:[bytes]! 3:max_values:[bytes]! 4:boundary_order:int! 5:null_counts:[int] 6:repetition_level_histograms:[int] 7:definition_level_histograms:[int]
BloomFilterHeader 1:num_bytes:int! 2:algorithm:BloomAlgorithm! 3:hash:BloomHash! 4:compression:BloomCompression!
BloomAlgorithm 1:BLOCK:Empty
BloomHash 1:XXHASH:Empty
BloomCompression 1:UNCOMPRESSED:Empty
"""


@dataclass(frozen=True)
class Record:
    name: str
    fields: dict[int, tuple[str, str | list[str]]]
    required: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields.values()]


def _declared() -> dict[str, Record]:
    found = {}
    for line in DEFINITION.strip().splitlines():
        name, *fields = line.split(" ")
        known, required = {}, []
        for field in fields:
            number, own, kind = field.split(":")
            if kind.endswith("!"):
                required.append(own)
                kind = kind[:-1]
            known[int(number)] = (own, [kind[1:-1]] if kind.startswith("[") else kind)
        found[name] = Record(name, known, tuple(required))
    return found


RECORDS = _declared()

#: Names of numbered values (public format specification). Fixed values.
PHYSICAL_TYPES = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
CONVERTED_TYPES = ("UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL")
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
PAGE_TYPES = ("DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2")
BOUNDARY_ORDERS = ("UNORDERED", "ASCENDING", "DESCENDING")
EDGE_ALGORITHMS = ("SPHERICAL", "VINCENTY", "THOMAS", "ANDOYER", "KARNEY")
#: Shapes of well-known binary; thousands say which further axes there are.
WKB_SHAPES = ("GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "CIRCULARSTRING", "COMPOUNDCURVE", "CURVEPOLYGON", "MULTICURVE", "MULTISURFACE", "CURVE", "SURFACE", "POLYHEDRALSURFACE", "TIN")
WKB_AXES = ("", "_Z", "_M", "_ZM")


def named(names: tuple[str, ...] | dict[int, str], value: int | None, what: str) -> str | None:
    """Name of a numbered value; an unknown number is damage."""
    from ..errors import CorruptFile

    if value is None:
        return None
    found = names.get(value) if isinstance(names, dict) else names[value] if 0 <= value < len(names) else None
    if found is None:
        raise CorruptFile(f"{what} {value} is unknown")
    return found


def wkb_type(value: int) -> str:
    axes, shape = divmod(value, 1000)
    return named(WKB_SHAPES, shape, "geometry type") + named(WKB_AXES, axes, "geometry axes")
