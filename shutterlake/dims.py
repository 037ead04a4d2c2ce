"""Small dimension tables as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Formats, their file extensions and MIME types.
FORMATS = [
    ("jpeg", "jpg", "image/jpeg"),
    ("png", "png", "image/png"),
    ("webp", "webp", "image/webp"),
    ("avif", "avif", "image/avif"),
    ("heic", "heic", "image/heic"),
    ("tiff", "tiff", "image/tiff"),
    ("gif", "gif", "image/gif"),
    ("bmp", "bmp", "image/bmp"),
    ("unknown", "bin", "application/octet-stream"),
]

#: The nine removable categories and whether they go by default.
CATEGORIES = [("exif", True), ("gps", True), ("xmp", True), ("iptc", True), ("icc", False), ("c2pa", True), ("ai", True), ("comment", True), ("other", True)]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, extension string, mime string")


def policy(spark: SparkSession, **overrides: bool) -> DataFrame:
    """(category, remove): the default policy with some switches set otherwise."""
    return spark.createDataFrame([(c, overrides.get(c, on)) for c, on in CATEGORIES], "category string, remove boolean")


def removed(**overrides: bool) -> frozenset[str]:
    """Names of the categories that go, for operators that need the whole policy at once."""
    return frozenset(c for c, on in CATEGORIES if overrides.get(c, on))


def switched_off(policy: DataFrame) -> frozenset[str]:
    """Names of the categories that a (category, remove) table takes out; names of no switch are an error, so it is nine rows at most."""
    names = [c for c, _ in CATEGORIES]
    known = policy.where("remove").select("category").distinct().limit(len(names) + 1).collect()
    odd = [r["category"] for r in known if r["category"] not in names]
    if odd:
        raise ValueError(f"no such category: {odd[0]}")
    return frozenset(r["category"] for r in known)


#: Error codes and what is said of them.
MOST_BYTES, LEAST_BYTES = 256 << 20, 12
ERRORS = {
    "empty-file": "The file is empty.",
    "corrupt-container": "The file is too small to contain an image header.",
    "too-large": f"The file is larger than the {MOST_BYTES >> 20} MB limit.",
    "unsupported-format": "This file is not a recognised image container.",
}

#: Names of TIFF and EXIF tags, and of GPS tags.
TAGS = {254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 263: "Threshholding", 264: "CellWidth", 265: "CellLength", 266: "FillOrder", 269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 280: "MinSampleValue", 281: "MaxSampleValue", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 285: "PageName", 286: "XPosition", 287: "YPosition", 288: "FreeOffsets", 289: "FreeByteCounts", 290: "GrayResponseUnit", 291: "GrayResponseCurve", 292: "T4Options", 293: "T6Options", 296: "ResolutionUnit", 297: "PageNumber", 301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 317: "Predictor", 318: "WhitePoint", 319: "PrimaryChromaticities", 320: "ColorMap", 321: "HalftoneHints", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 330: "SubIFDs", 332: "InkSet", 333: "InkNames", 334: "NumberOfInks", 336: "DotRange", 337: "TargetPrinter", 338: "ExtraSamples", 339: "SampleFormat", 340: "SMinSampleValue", 341: "SMaxSampleValue", 342: "TransferRange", 343: "ClipPath", 512: "JPEGProc", 513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 515: "JPEGRestartInterval", 517: "JPEGQTables", 518: "JPEGDCTables", 519: "JPEGACTables", 529: "YCbCrCoefficients", 530: "YCbCrSubSampling", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 700: "XMP", 18246: "Rating", 18249: "RatingPercent", 32781: "ImageID", 33421: "CFARepeatPatternDim", 33422: "CFAPattern", 33423: "BatteryLevel", 33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 33723: "IPTCNAA", 34377: "PhotoshopSettings", 34665: "ExifIFDPointer", 34675: "InterColorProfile", 34850: "ExposureProgram", 34852: "SpectralSensitivity", 34853: "GPSIFDPointer", 34855: "ISOSpeedRatings", 34856: "OECF", 34864: "SensitivityType", 34866: "RecommendedExposureIndex", 36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 36880: "OffsetTime", 36881: "OffsetTimeOriginal", 36882: "OffsetTimeDigitized", 37121: "ComponentsConfiguration", 37122: "CompressedBitsPerPixel", 37377: "ShutterSpeedValue", 37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue", 37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength", 37396: "SubjectArea", 37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 37522: "SubSecTimeDigitized", 40960: "FlashpixVersion", 40961: "ColorSpace", 40962: "PixelXDimension", 40963: "PixelYDimension", 40964: "RelatedSoundFile", 40965: "InteroperabilityIFDPointer", 41483: "FlashEnergy", 41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution", 41488: "FocalPlaneResolutionUnit", 41492: "SubjectLocation", 41493: "ExposureIndex", 41495: "SensingMethod", 41728: "FileSource", 41729: "SceneType", 41985: "CustomRendered", 41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm", 41990: "SceneCaptureType", 41991: "GainControl", 41992: "Contrast", 41993: "Saturation", 41994: "Sharpness", 41996: "SubjectDistanceRange", 42016: "ImageUniqueID", 42032: "CameraOwnerName", 42033: "BodySerialNumber", 42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel", 42037: "LensSerialNumber", 42240: "Gamma", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject", 50341: "PrintImageMatching", 50706: "DNGVersion", 50707: "DNGBackwardVersion", 50708: "UniqueCameraModel", 50735: "CameraSerialNumber", 50827: "OriginalRawFileName", 50828: "OriginalRawFileData", 59932: "Padding"}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 19: "GPSDestLatitudeRef", 20: "GPSDestLatitude", 21: "GPSDestLongitudeRef", 22: "GPSDestLongitude", 29: "GPSDateStamp", 30: "GPSDifferential", 31: "GPSHPositioningError"}
#: Names of JPEG frames by marker.
FRAMES = {0xC0: "Baseline DCT", 0xC1: "Extended sequential DCT", 0xC2: "Progressive DCT", 0xC3: "Lossless (sequential)", 0xC5: "Differential sequential DCT", 0xC6: "Differential progressive DCT", 0xC7: "Differential lossless", 0xC9: "Extended sequential DCT, arithmetic", 0xCA: "Progressive DCT, arithmetic", 0xCB: "Lossless, arithmetic", 0xCD: "Differential sequential DCT, arithmetic", 0xCE: "Differential progressive DCT, arithmetic", 0xCF: "Differential lossless, arithmetic"}


def tag_name(tag: int, gps: bool = False) -> str:
    """Name of a tag, or its number in hex."""
    return (GPS_TAGS if gps else TAGS).get(tag, f"Tag 0x{tag:04x}")


def tags(spark: SparkSession) -> DataFrame:
    """(gps, tag, name): the tag dictionary, about 190 rows."""
    return spark.createDataFrame([(gps, t, n) for gps, table in ((False, TAGS), (True, GPS_TAGS)) for t, n in table.items()], "gps boolean, tag int, name string")
