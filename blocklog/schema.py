"""Record layouts and constants of the engine."""

from pyspark.sql import types as T

# Fixed values of the data model.
SECTOR_BYTES = 512
SECTORS_PER_BLOCK = 8
BLOCK_BYTES = SECTOR_BYTES * SECTORS_PER_BLOCK
BLOCKS_PER_SEGMENT = 1024
SECTORS_PER_SEGMENT = SECTORS_PER_BLOCK * BLOCKS_PER_SEGMENT
FILE_RECORDS = 131072
LEAF_RECORDS = 128
NODE_FANOUT = 32
LEVEL_RATIO = 10
DISK_LEVELS = 2
LEVEL0_FILES = 1
GC_RESERVED_SEGMENTS = 320
GC_SEGMENTS_PER_PASS = 5
JOURNAL_SEGMENTS = 16
CHECKPOINT_COPIES = 2
LEAF_CACHE = 128
SUPERBLOCK_MAGIC = 0x22946
CHECKSUM_XOR = 0x3828
# Fixed sizes in bytes of encoded structures.
LEAF_NODE_BYTES = 5665
INNER_NODE_BYTES = 441
FILE_STAT_BYTES = 88
SEGMENT_ENTRY_BYTES = 136
REVERSE_ENTRY_BYTES = 8
WORD_BITS = 64


def fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


WRITE = "wseq long, lba long, tomb boolean, payload double"
RECORD = "pba long, mac binary, key binary"
FILE_STAT = "id long, level long, version long, first_key long, last_key long, nr_record long, root long, root_key binary, root_iv binary"
LEAF_INDEX = "leaf long, max_key long, nr_record long"
REVERSE_INDEX = "pba long, lba long"
SEGMENT_ENTRY = "seg long, nr_valid long, bitmap binary"
JOURNAL_RECORD = (
    "rec long, type string, ts long,"
    " data_log struct<lba: long, hba: long, key: binary, mac: binary, iv: binary>,"
    " compaction struct<file_id: long, level: long, version: long, upper: binary, lower: binary>,"
    " node struct<file_id: long, pos: long, is_leaf: boolean, is_done: boolean, key: binary, mac: binary, iv: binary>,"
    " checkpoint struct<record_start: long, record_end: long, valid_fields: binary, key: binary, mac: binary, iv: binary>"
)
STATISTICS = "reads long, writes long, read_bytes long, write_bytes long"
