"""Dimension tables: names, signatures and formats that operators join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of EXIF, GPS and TIFF tags as the EXIF and TIFF standards number them.
TAGS: dict[str, dict[int, str]] = {
    "exif": {
        0x829A: "Exposure Time",
        0x829D: "F-Number (Aperture)",
        0x8822: "Exposure Program",
        0x8824: "Spectral Sensitivity",
        0x8827: "ISO Speed Ratings",
        0x8828: "OECF",
        0x9000: "Exif Version",
        0x9003: "Date and Time (Original)",
        0x9004: "Date and Time (Digitized)",
        0x9101: "Components Configuration",
        0x9102: "Compressed Bits Per Pixel",
        0x9201: "Shutter Speed Value",
        0x9202: "Aperture Value",
        0x9203: "Brightness Value",
        0x9204: "Exposure Bias Value",
        0x9205: "Max Aperture Value",
        0x9206: "Subject Distance",
        0x9207: "Metering Mode",
        0x9208: "Light Source",
        0x9209: "Flash",
        0x920A: "Focal Length",
        0x927C: "Maker Note",
        0x9286: "User Comment",
        0x9290: "SubSec Time",
        0x9291: "SubSec Time (Original)",
        0x9292: "SubSec Time (Digitized)",
        0xA000: "Flashpix Version",
        0xA001: "Color Space",
        0xA002: "Pixel X Dimension",
        0xA003: "Pixel Y Dimension",
        0xA004: "Related Sound File",
        0xA20E: "Focal Plane X Resolution",
        0xA20F: "Focal Plane Y Resolution",
        0xA210: "Focal Plane Resolution Unit",
        0xA217: "Sensing Method",
        0xA300: "File Source",
        0xA301: "Scene Type",
        0xA302: "CFA Pattern",
        0xA401: "Custom Rendered",
        0xA402: "Exposure Mode",
        0xA403: "White Balance",
        0xA404: "Digital Zoom Ratio",
        0xA405: "Focal Length in 35mm Film",
        0xA406: "Scene Capture Type",
        0xA407: "Gain Control",
        0xA408: "Contrast",
        0xA409: "Saturation",
        0xA40A: "Sharpness",
        0xA40C: "Subject Distance Range",
        0xA420: "Unique Image ID",
        0xA430: "Camera Owner Name",
        0xA431: "Body Serial Number",
        0xA432: "Lens Specification",
        0xA433: "Lens Make",
        0xA434: "Lens Model",
        0xA435: "Lens Serial Number",
    },
    "gps": {
        0x0000: "GPS Version ID",
        0x0001: "GPS Latitude Ref",
        0x0002: "GPS Latitude",
        0x0003: "GPS Longitude Ref",
        0x0004: "GPS Longitude",
        0x0005: "GPS Altitude Ref",
        0x0006: "GPS Altitude",
        0x0007: "GPS Time Stamp",
        0x0008: "GPS Satellites",
        0x0009: "GPS Status",
        0x000A: "GPS Measure Mode",
        0x000B: "GPS DOP",
        0x000C: "GPS Speed Ref",
        0x000D: "GPS Speed",
        0x000E: "GPS Track Ref",
        0x000F: "GPS Track",
        0x0010: "GPS Img Direction Ref",
        0x0011: "GPS Img Direction",
        0x0012: "GPS Map Datum",
        0x0013: "GPS Dest Latitude Ref",
        0x0014: "GPS Dest Latitude",
        0x0015: "GPS Dest Longitude Ref",
        0x0016: "GPS Dest Longitude",
        0x001D: "GPS Date Stamp",
        0x001E: "GPS Differential",
    },
    "tiff": {
        0x0100: "Image Width",
        0x0101: "Image Height",
        0x0102: "Bits Per Sample",
        0x0103: "Compression",
        0x0106: "Photometric Interpretation",
        0x010E: "Image Description",
        0x010F: "Make (Camera Manufacturer)",
        0x0110: "Model (Camera Model)",
        0x0111: "Strip Offsets",
        0x0112: "Orientation",
        0x0115: "Samples Per Pixel",
        0x0116: "Rows Per Strip",
        0x0117: "Strip Byte Counts",
        0x011A: "X Resolution",
        0x011B: "Y Resolution",
        0x011C: "Planar Configuration",
        0x0128: "Resolution Unit",
        0x0131: "Software",
        0x0132: "Date and Time",
        0x013B: "Artist",
        0x013E: "White Point",
        0x013F: "Primary Chromaticities",
        0x0211: "YCbCr Coefficients",
        0x0213: "YCbCr Positioning",
        0x0214: "Reference Black/White",
        0x8298: "Copyright",
    },
}

# Display names of containers.
CONTAINERS = {
    "jpeg": "JPEG Image Container",
    "png": "PNG Image Container",
    "webp": "WebP RIFF Container",
    "gif": "GIF Image Container",
    "heic": "HEIC/HEIF ISOBMFF Container",
    "unknown": "Unknown Binary Container",
}

# Names of JPEG markers (0xE2 to 0xEF share one, as do 0xD0 to 0xD7).
JPEG_MARKERS = {
    0xD8: "SOI (Start of Image)",
    0xD9: "EOI (End of Image)",
    **{m: "RST (Restart Marker)" for m in range(0xD0, 0xD8)},
    0xC0: "SOF0 (Baseline DCT)",
    0xC1: "SOF1 (Extended Sequential)",
    0xC2: "SOF2 (Progressive DCT)",
    0xC3: "SOF3 (Lossless)",
    0xC4: "DHT (Define Huffman Table)",
    0xDB: "DQT (Define Quantization Table)",
    0xDD: "DRI (Define Restart Interval)",
    0xDA: "SOS (Start of Scan)",
    0xFE: "COM (Comment)",
    0xE0: "APP0 (JFIF / JFXX)",
    0xE1: "APP1 (EXIF / XMP)",
    **{m: "APP (Application Specific)" for m in range(0xE2, 0xF0)},
}
UNKNOWN_MARKER = "Unknown Segment"

# Names of GIF extensions by label.
GIF_EXTENSIONS = {0xF9: "Graphic Control Extension", 0xFE: "Comment Extension", 0x01: "Plain Text Extension", 0xFF: "Application Extension"}

# Signatures of embedded files, in the order in which hits are listed.
SIGNATURES = [
    (b"PK\x03\x04", "ZIP Archive", "Archive"),
    (b"MZ", "Windows Portable Executable (PE)", "Binary"),
    (b"\x7fELF", "Linux ELF Binary", "Binary"),
    (b"%PDF", "PDF Document", "Document"),
    (b"<?php", "PHP Script Block", "Script"),
    (b"<script", "JavaScript/HTML Script Block", "Script"),
    (b"eval(", "Suspicious Eval Function Call", "Script Injection"),
    (b"system(", "Suspicious System Execution Call", "Script Injection"),
    (b"base64_decode(", "Suspicious Base64 Payload Decoder", "Script Injection"),
    (b"\x89PNG\r\n\x1a\n", "Embedded PNG Image", "Image"),
    (b"\xff\xd8\xff", "Embedded JPEG Image", "Image"),
]
PE_NAME = "Windows Portable Executable (PE)"
OVERLAY_NAME, OVERLAY_CATEGORY = "Trailing Data (Overlay)", "Overlay"

# Extensions, their format, its kind and its own extension.
FORMATS = [
    ("jpg", "jpeg", "image", "jpg"),
    ("jpeg", "jpeg", "image", "jpg"),
    ("png", "png", "image", "png"),
    ("webp", "webp", "image", "webp"),
    ("bmp", "bmp", "image", "bmp"),
    ("tif", "tiff", "image", "tiff"),
    ("tiff", "tiff", "image", "tiff"),
    ("gif", "gif", "image", "gif"),
    ("wav", "wav", "audio", "wav"),
    ("mp3", "mp3", "audio", "mp3"),
    ("flac", "flac", "audio", "flac"),
    ("ogg", "ogg", "audio", "ogg"),
    ("oga", "ogg", "audio", "ogg"),
    ("aac", "aac", "audio", "aac"),
    ("m4a", "aac", "audio", "aac"),
    ("mp4", "mp4", "video", "mp4"),
    ("mkv", "mkv", "video", "mkv"),
    ("webm", "webm", "video", "webm"),
    ("avi", "avi", "video", "avi"),
    ("mov", "mov", "video", "mov"),
]

# What a source of one kind can become; the rest is refused with the reason given.
CONVERSIONS = {("image", "image"), ("audio", "audio"), ("video", "video"), ("video", "audio"), ("video", "image")}


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, n) for c, t in TAGS.items() for i, n in t.items()], "category string, tag_id int, name string")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "extension string, format string, kind string, own_extension string")


def markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(JPEG_MARKERS.items()), "marker int, name string")


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(m), n, c) for i, (m, n, c) in enumerate(SIGNATURES)], "pos int, magic binary, name string, category string")


def conversions(spark: SparkSession) -> DataFrame:
    kinds = ("image", "audio", "video")
    return spark.createDataFrame([(a, b, (a, b) in CONVERSIONS) for a in kinds for b in kinds], "source string, target string, supported boolean")
