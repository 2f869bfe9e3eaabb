"""Fixed values of the packet, stream and container formats."""

MAGIC, NEWEST, LARGEST_SIDE, LARGEST = bytes.fromhex("544356"), 2, 4096, 100 << 20
KEY, RAP, CRC, EXTENDED = 0x80, 0x20, 0x10, 0x08
TOOLS = 0xC5FF  # the tool bits that a reader knows
DEFAULT_QP, PROFILES = 32, 3
STREAM_MAGIC, SEGMENT_MAGIC, RECORD_MAGIC, VERSION = b"TCMX", b"TCMF", b"PKT0", 1
HEADER, RECORD = 16, 20
LEVELS = (
    (0, 4096, 4096, 8, 0), (1, 320, 240, 1, 500_000), (2, 640, 480, 2, 2_000_000), (3, 1280, 720, 2, 5_000_000), (4, 1280, 720, 4, 10_000_000),
    (5, 1920, 1080, 4, 20_000_000), (6, 1920, 1080, 4, 40_000_000), (7, 3840, 2160, 4, 80_000_000), (8, 3840, 2160, 8, 160_000_000),
)
