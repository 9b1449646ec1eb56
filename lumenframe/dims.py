"""Constant tables of the DICOM standard as Python rows and as DataFrames.

The full tag dictionary and the full de-identification table are data that users load (sources.dictionaries); the rows
here are a seed of attributes that the engine itself needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(text: str) -> int:
    """A tag from "GGGG,EEEE"."""
    group, element = text.split(",")
    return int(group, 16) << 16 | int(element, 16)


# Value representations with name, pad byte, longest value (None: no limit), string, 16-bit length
# field, undefined length allowed, value delimiter.
VR = [
    ("AE", "Application Entity", 32, 16, True, True, False, "\\"),
    ("AS", "Age String", 32, 4, True, True, False, None),
    ("AT", "Attribute Tag", 0, 4, False, True, False, None),
    ("CS", "Code String", 32, 16, True, True, False, "\\"),
    ("DA", "Date", 32, 8, True, True, False, "\\"),
    ("DS", "Decimal String", 32, 16, True, True, False, "\\"),
    ("DT", "Date Time", 32, 26, True, True, False, "\\"),
    ("FD", "Floating Point Double", 0, 8, False, True, False, None),
    ("FL", "Floating Point Single", 0, 4, False, True, False, None),
    ("IS", "Integer String", 32, 12, True, True, False, "\\"),
    ("LO", "Long String", 32, 64, True, True, False, "\\"),
    ("LT", "Long Text", 32, 10240, True, True, False, None),
    ("OB", "Other Byte", 0, None, False, False, True, None),
    ("OD", "Other Double", 0, None, False, False, False, None),
    ("OF", "Other Float", 0, None, False, False, False, None),
    ("OL", "Other Long", 0, None, False, False, False, None),
    ("OV", "Other Very Long", 0, None, False, False, False, None),
    ("OW", "Other Word", 0, None, False, False, True, None),
    ("PN", "Person Name", 32, 64, True, True, False, "\\"),
    ("SH", "Short String", 32, 16, True, True, False, "\\"),
    ("SL", "Signed Long", 0, 4, False, True, False, None),
    ("SQ", "Sequence of Items", 0, None, False, False, True, None),
    ("SS", "Signed Short", 0, 2, False, True, False, None),
    ("ST", "Short Text", 32, 1024, True, True, False, None),
    ("SV", "Signed Very Long", 0, 8, False, False, False, None),
    ("TM", "Time", 32, 14, True, True, False, "\\"),
    ("UC", "Unlimited Characters", 32, None, True, False, False, "\\"),
    ("UI", "Unique Identifier", 0, 64, True, True, False, "\\"),
    ("UL", "Unsigned Long", 0, 4, False, True, False, None),
    ("UN", "Unknown", 0, None, False, False, True, None),
    ("UR", "Universal Resource", 32, None, True, False, False, None),
    ("US", "Unsigned Short", 0, 2, False, True, False, None),
    ("UT", "Unlimited Text", 32, None, True, False, False, None),
    ("UV", "Unsigned Very Long", 0, 8, False, False, False, None),
]
VR_SCHEMA = "vr string, name string, pad int, max_len long, is_string boolean, short_length boolean, undefined_ok boolean, delimiter string"
STRING_VRS = [r[0] for r in VR if r[4]]
LONG_LENGTH_VRS = [r[0] for r in VR if not r[5]]
NUMERIC_VRS = ["FD", "FL", "SL", "SS", "SV", "UL", "US", "UV"]

# Attributes with keyword, value representations and multiplicity (command and file meta groups, then the
# data set groups in order of tag).
TAGS = [
    ("0000,0000", "CommandGroupLength", "UL", "1"),
    ("0000,0002", "AffectedSOPClassUID", "UI", "1"),
    ("0000,0003", "RequestedSOPClassUID", "UI", "1"),
    ("0000,0100", "CommandField", "US", "1"),
    ("0000,0110", "MessageID", "US", "1"),
    ("0000,0120", "MessageIDBeingRespondedTo", "US", "1"),
    ("0000,0600", "MoveDestination", "AE", "1"),
    ("0000,0700", "Priority", "US", "1"),
    ("0000,0800", "CommandDataSetType", "US", "1"),
    ("0000,0900", "Status", "US", "1"),
    ("0000,0901", "OffendingElement", "AT", "1-n"),
    ("0000,0902", "ErrorComment", "LO", "1"),
    ("0000,0903", "ErrorID", "US", "1"),
    ("0000,1000", "AffectedSOPInstanceUID", "UI", "1"),
    ("0000,1001", "RequestedSOPInstanceUID", "UI", "1"),
    ("0000,1002", "EventTypeID", "US", "1"),
    ("0000,1005", "AttributeIdentifierList", "AT", "1-n"),
    ("0000,1008", "ActionTypeID", "US", "1"),
    ("0000,1020", "NumberOfRemainingSuboperations", "US", "1"),
    ("0000,1021", "NumberOfCompletedSuboperations", "US", "1"),
    ("0000,1022", "NumberOfFailedSuboperations", "US", "1"),
    ("0000,1023", "NumberOfWarningSuboperations", "US", "1"),
    ("0000,1030", "MoveOriginatorApplicationEntityTitle", "AE", "1"),
    ("0000,1031", "MoveOriginatorMessageID", "US", "1"),
    ("0002,0000", "FileMetaInformationGroupLength", "UL", "1"),
    ("0002,0001", "FileMetaInformationVersion", "OB", "1"),
    ("0002,0002", "MediaStorageSOPClassUID", "UI", "1"),
    ("0002,0003", "MediaStorageSOPInstanceUID", "UI", "1"),
    ("0002,0010", "TransferSyntaxUID", "UI", "1"),
    ("0002,0012", "ImplementationClassUID", "UI", "1"),
    ("0002,0013", "ImplementationVersionName", "SH", "1"),
    ("0002,0016", "SourceApplicationEntityTitle", "AE", "1"),
    ("0008,0005", "SpecificCharacterSet", "CS", "1-n"),
    ("0008,0008", "ImageType", "CS", "2-n"),
    ("0008,0016", "SOPClassUID", "UI", "1"),
    ("0008,0018", "SOPInstanceUID", "UI", "1"),
    ("0008,0020", "StudyDate", "DA", "1"),
    ("0008,0021", "SeriesDate", "DA", "1"),
    ("0008,0022", "AcquisitionDate", "DA", "1"),
    ("0008,0023", "ContentDate", "DA", "1"),
    ("0008,002A", "AcquisitionDateTime", "DT", "1"),
    ("0008,0030", "StudyTime", "TM", "1"),
    ("0008,0050", "AccessionNumber", "SH", "1"),
    ("0008,0052", "QueryRetrieveLevel", "CS", "1"),
    ("0008,0060", "Modality", "CS", "1"),
    ("0008,0061", "ModalitiesInStudy", "CS", "1-n"),
    ("0008,0070", "Manufacturer", "LO", "1"),
    ("0008,0080", "InstitutionName", "LO", "1"),
    ("0008,0090", "ReferringPhysicianName", "PN", "1"),
    ("0008,0115", "CodingSchemeURI", "UR", "1"),
    ("0008,1030", "StudyDescription", "LO", "1"),
    ("0008,103E", "SeriesDescription", "LO", "1"),
    ("0008,1115", "ReferencedSeriesSequence", "SQ", "1"),
    ("0008,1140", "ReferencedImageSequence", "SQ", "1"),
    ("0010,0010", "PatientName", "PN", "1"),
    ("0010,0020", "PatientID", "LO", "1"),
    ("0010,0030", "PatientBirthDate", "DA", "1"),
    ("0010,0040", "PatientSex", "CS", "1"),
    ("0010,1010", "PatientAge", "AS", "1"),
    ("0010,1030", "PatientWeight", "DS", "1"),
    ("0012,0062", "PatientIdentityRemoved", "CS", "1"),
    ("0012,0063", "DeidentificationMethod", "LO", "1-n"),
    ("0012,0064", "DeidentificationMethodCodeSequence", "SQ", "1"),
    ("0018,1000", "DeviceSerialNumber", "LO", "1"),
    ("0020,000D", "StudyInstanceUID", "UI", "1"),
    ("0020,000E", "SeriesInstanceUID", "UI", "1"),
    ("0020,0013", "InstanceNumber", "IS", "1"),
    ("0028,0002", "SamplesPerPixel", "US", "1"),
    ("0028,0004", "PhotometricInterpretation", "CS", "1"),
    ("0028,0006", "PlanarConfiguration", "US", "1"),
    ("0028,0008", "NumberOfFrames", "IS", "1"),
    ("0028,0010", "Rows", "US", "1"),
    ("0028,0011", "Columns", "US", "1"),
    ("0028,0100", "BitsAllocated", "US", "1"),
    ("0028,0101", "BitsStored", "US", "1"),
    ("0028,0102", "HighBit", "US", "1"),
    ("0028,0103", "PixelRepresentation", "US", "1"),
    ("0028,0106", "SmallestImagePixelValue", "US or SS", "1"),
    ("0028,0107", "LargestImagePixelValue", "US or SS", "1"),
    ("0028,0120", "PixelPaddingValue", "US or SS", "1"),
    ("0028,0301", "BurnedInAnnotation", "CS", "1"),
    ("0028,0303", "LongitudinalTemporalInformationModified", "CS", "1"),
    ("3006,0020", "StructureSetROISequence", "SQ", "1"),
    ("3006,0022", "ROINumber", "IS", "1"),
    ("7FE0,0001", "ExtendedOffsetTable", "OV", "1"),
    ("7FE0,0002", "ExtendedOffsetTableLengths", "OV", "1"),
    ("7FE0,0010", "PixelData", "OB or OW", "1"),
]
KEYWORD = {k: t(x) for x, k, _, _ in TAGS}
DICTIONARY = {t(x): vr.split(" or ")[0] for x, _, vr, _ in TAGS}

# Transfer syntaxes with explicit, little endian, encapsulated, lossy, compression.
TRANSFER_SYNTAXES = [
    ("1.2.840.10008.1.2", False, True, False, False, "none"),
    ("1.2.840.10008.1.2.1", True, True, False, False, "none"),
    ("1.2.840.10008.1.2.1.99", True, True, False, False, "deflate"),
    ("1.2.840.10008.1.2.2", True, False, False, False, "none"),
    ("1.2.840.10008.1.2.4.50", True, True, True, True, "jpeg-baseline"),
    ("1.2.840.10008.1.2.4.70", True, True, True, False, "jpeg-lossless"),
    ("1.2.840.10008.1.2.4.80", True, True, True, False, "jpeg-ls"),
    ("1.2.840.10008.1.2.4.81", True, True, True, True, "jpeg-ls-near"),
    ("1.2.840.10008.1.2.4.90", True, True, True, False, "jpeg2000"),
    ("1.2.840.10008.1.2.4.91", True, True, True, True, "jpeg2000-lossy"),
    ("1.2.840.10008.1.2.5", True, True, True, False, "rle"),
]
IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
RLE_SYNTAX, JPEG_LOSSLESS, JPEG_BASELINE = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.70", "1.2.840.10008.1.2.4.50"
SYNTAX = {r[0]: r[1:] for r in TRANSFER_SYNTAXES}

# query/retrieve SOP classes by root, level and verb.
QR_CLASSES = [
    ("patient", "find", "1.2.840.10008.5.1.4.1.2.1.1"),
    ("patient", "move", "1.2.840.10008.5.1.4.1.2.1.2"),
    ("patient", "get", "1.2.840.10008.5.1.4.1.2.1.3"),
    ("study", "find", "1.2.840.10008.5.1.4.1.2.2.1"),
    ("study", "move", "1.2.840.10008.5.1.4.1.2.2.2"),
    ("study", "get", "1.2.840.10008.5.1.4.1.2.2.3"),
]
# Other registered UIDs the engine names.
UIDS = [
    ("1.2.840.10008.1.1", "Verification"),
    ("1.2.840.10008.5.1.4.1.1.1.1", "DigitalXRayImageStorageForPresentation"),
    ("1.2.840.10008.5.1.4.1.1.1.1.1", "DigitalXRayImageStorageForProcessing"),
    ("1.2.840.10008.5.1.4.1.1.2", "CTImageStorage"),
    ("1.2.840.10008.5.1.4.1.1.4", "MRImageStorage"),
    ("1.2.840.10008.5.1.4.1.1.7", "SecondaryCaptureImageStorage"),
]

# Character set terms and the codecs of their primary encodings.
CHARSETS = [
    ("", "ascii"), ("ISO_IR 6", "ascii"), ("ISO_IR 100", "latin-1"), ("ISO_IR 101", "iso8859-2"), ("ISO_IR 109", "iso8859-3"),
    ("ISO_IR 110", "iso8859-4"), ("ISO_IR 144", "iso8859-5"), ("ISO_IR 127", "iso8859-6"), ("ISO_IR 126", "iso8859-7"),
    ("ISO_IR 138", "iso8859-8"), ("ISO_IR 148", "iso8859-9"), ("ISO_IR 203", "iso8859-15"), ("ISO_IR 13", "shift_jis"),
    ("ISO_IR 166", "tis-620"), ("ISO_IR 192", "utf-8"), ("GB18030", "gb18030"), ("GBK", "gbk"),
    ("ISO 2022 IR 6", "ascii"), ("ISO 2022 IR 100", "latin-1"), ("ISO 2022 IR 101", "iso8859-2"), ("ISO 2022 IR 109", "iso8859-3"),
    ("ISO 2022 IR 110", "iso8859-4"), ("ISO 2022 IR 144", "iso8859-5"), ("ISO 2022 IR 127", "iso8859-6"), ("ISO 2022 IR 126", "iso8859-7"),
    ("ISO 2022 IR 138", "iso8859-8"), ("ISO 2022 IR 148", "iso8859-9"), ("ISO 2022 IR 13", "shift_jis"), ("ISO 2022 IR 166", "tis-620"),
    ("ISO 2022 IR 87", "iso2022_jp"), ("ISO 2022 IR 159", "iso2022_jp_2"), ("ISO 2022 IR 149", "euc_kr"), ("ISO 2022 IR 58", "gb2312"),
]

# De-identification actions of common attributes. Columns after the tag: basic profile, then the options
# safe private, UIDs, device, institution, patient characteristics, full dates, modified dates, clean descriptors,
# clean structured content, clean graphics.
DEID = [
    ("0008,0014", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0008,0018", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0008,0020", "Z", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0021", "X/D", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0022", "X/Z", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0023", "Z/D", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,002A", "X/Z/D", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0030", "Z", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0031", "X/D", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0032", "X/Z", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0033", "Z/D", None, None, None, None, None, "K", "C", None, None, None),
    ("0008,0050", "Z", None, None, None, None, None, None, None, None, None, None),
    ("0008,0058", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0008,0080", "X/Z/D", None, None, None, "K", None, None, None, None, None, None),
    ("0008,0081", "X", None, None, None, "K", None, None, None, None, None, None),
    ("0008,0090", "Z", None, None, None, None, None, None, None, None, None, None),
    ("0008,0092", "X", None, None, None, None, None, None, None, None, None, None),
    ("0008,0094", "X", None, None, None, None, None, None, None, None, None, None),
    ("0008,1010", "X/Z/D", None, None, "K", None, None, None, None, None, None, None),
    ("0008,1030", "X", None, None, None, None, None, None, None, "C", None, None),
    ("0008,103E", "X", None, None, None, None, None, None, None, "C", None, None),
    ("0008,1040", "X", None, None, None, "K", None, None, None, None, None, None),
    ("0008,1048", "X", None, None, None, None, None, None, None, None, None, None),
    ("0008,1050", "X", None, None, None, None, None, None, None, None, None, None),
    ("0008,1070", "X/Z/D", None, None, None, None, None, None, None, None, None, None),
    ("0008,1155", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0010,0010", "Z", None, None, None, None, None, None, None, None, None, None),
    ("0010,0020", "Z/D", None, None, None, None, None, None, None, None, None, None),
    ("0010,0030", "Z", None, None, None, None, None, None, None, None, None, None),
    ("0010,0040", "Z", None, None, None, None, "K", None, None, None, None, None),
    ("0010,1000", "X", None, None, None, None, None, None, None, None, None, None),
    ("0010,1001", "X", None, None, None, None, None, None, None, None, None, None),
    ("0010,1010", "X", None, None, None, None, "K", None, None, None, None, None),
    ("0010,1020", "X", None, None, None, None, "K", None, None, None, None, None),
    ("0010,1030", "X", None, None, None, None, "K", None, None, None, None, None),
    ("0010,1040", "X", None, None, None, None, None, None, None, None, None, None),
    ("0010,2154", "X", None, None, None, None, None, None, None, None, None, None),
    ("0010,2160", "X", None, None, None, None, "K", None, None, None, None, None),
    ("0010,4000", "X", None, None, None, None, None, None, None, "C", None, None),
    ("0018,1000", "X/Z/D", None, None, "K", None, None, None, None, None, None, None),
    ("0018,1002", "U", None, "K", "K", None, None, None, None, None, None, None),
    ("0018,1030", "X/D", None, None, None, None, None, None, None, "C", None, None),
    ("0020,000D", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0020,000E", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0020,0010", "Z", None, None, None, None, None, None, None, None, None, None),
    ("0020,0052", "U", None, "K", None, None, None, None, None, None, None, None),
    ("0020,4000", "X", None, None, None, None, None, None, None, "C", None, None),
    ("0032,1032", "X", None, None, None, None, None, None, None, None, None, None),
    ("0040,A730", "D", None, None, None, None, None, None, None, None, "C", None),
    ("0070,0001", "D", None, None, None, None, None, None, None, None, None, "C"),
]
DEID_OPTIONS = ["rsp", "ruid", "rdev", "rinst", "rpat", "rfull", "rmod", "cdesc", "cstruct", "cgraph"]
DEID_SCHEMA = "tag long, basic string, " + ", ".join(f"{o} string" for o in DEID_OPTIONS)

# What an action means for attribute types 1, 2 and 3.
RESOLVE = [
    ("K", "keep", "keep", "keep"),
    ("X", "remove", "remove", "remove"),
    ("Z", "empty", "empty", "empty"),
    ("D", "dummy", "dummy", "dummy"),
    ("C", "clean", "clean", "clean"),
    ("U", "remap_uid", "remap_uid", "remap_uid"),
    ("Z/D", "dummy", "empty", "empty"),
    ("X/Z", "remove", "empty", "remove"),
    ("X/D", "dummy", "remove", "remove"),
    ("X/Z/D", "dummy", "empty", "remove"),
    ("X/Z/U*", "remap_uid", "empty", "remove"),
]

# Dummy values by value representation, in the order of VR; zeros of the numbers as text. Others are emptied.
DUMMY = [
    ("AE", "ANONYMOUS"), ("AS", "000Y"), ("AT", "00000000"), ("CS", "ANON"), ("DA", "19000101"), ("DS", "0"), ("DT", "19000101000000.000000"), ("FD", "0"), ("FL", "0"),
    ("IS", "0"), ("LO", "ANONYMIZED"), ("LT", "ANONYMIZED"), ("PN", "ANONYMOUS"), ("SH", "ANON"), ("SL", "0"), ("SS", "0"), ("ST", "ANONYMIZED"), ("SV", "0"),
    ("TM", "000000.000000"), ("UC", "ANONYMIZED"), ("UI", "2.25.0"), ("UL", "0"), ("UR", "http://example.com"), ("US", "0"), ("UT", "ANONYMIZED"), ("UV", "0"),
]

# Codes of the de-identification methods by option.
METHOD_CODES = [
    ("basic", "113100"), ("rsp", "113101"), ("cgraph", "113103"), ("cstruct", "113104"), ("cdesc", "113105"), ("rfull", "113106"),
    ("rmod", "113107"), ("rpat", "113108"), ("rdev", "113109"), ("ruid", "113110"), ("rinst", "113112"),
]

# Meanings of the codes of de-identification methods (context group 7050 of the standard).
METHOD_MEANINGS = {
    "113100": "Basic Application Confidentiality Profile", "113101": "Clean Pixel Data Option", "113102": "Clean Recognizable Visual Features Option", "113103": "Clean Graphics Option",
    "113104": "Clean Structured Content Option", "113105": "Clean Descriptors Option", "113106": "Retain Longitudinal Temporal Information Full Dates Option",
    "113107": "Retain Longitudinal Temporal Information Modified Dates Option", "113108": "Retain Patient Characteristics Option", "113109": "Retain Device Identity Option",
    "113110": "Retain UIDs Option", "113111": "Retain Safe Private Option", "113112": "Retain Institution Identity Option",
}

# Modalities by the risk of text in their pixels.
HIGH_RISK = ["US", "ES", "SC", "XC", "GM", "SM", "OP", "OPT", "ECG", "HD"]
MODERATE_RISK = ["XA", "RF", "MG", "DX", "CR", "PX", "IO"]

# Issue codes.
ISSUE_CODES = [
    (1, "invalid tag"), (2, "invalid VR"), (3, "VR mismatch"), (4, "value too long"), (5, "value multiplicity"), (6, "padding byte"), (7, "date format"),
    (8, "time format"), (9, "UID format"), (10, "person name format"), (11, "truncated element"), (12, "sequence structure"), (13, "invalid character"),
    (14, "odd length"), (15, "missing required"), (16, "missing conditional"), (17, "empty required"), (18, "present when not allowed"),
    (19, "decimal string"), (20, "integer string"), (21, "age string"), (22, "code string"), (23, "out of range"), (24, "non-standard term"),
    (25, "deprecated"), (26, "date value"), (27, "time value"),
]

# DIMSE request fields; a response is its request with 0x8000.
COMMANDS = [
    (0x0001, "C-STORE"), (0x0010, "C-GET"), (0x0020, "C-FIND"), (0x0021, "C-MOVE"), (0x0030, "C-ECHO"), (0x0100, "N-EVENT-REPORT"), (0x0110, "N-GET"),
    (0x0120, "N-SET"), (0x0130, "N-ACTION"), (0x0140, "N-CREATE"), (0x0150, "N-DELETE"), (0x0FFF, "C-CANCEL"),
]


def dim_vr(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VR, VR_SCHEMA)


def dim_tag(spark: SparkSession) -> DataFrame:
    rows = [(t(x), 0xFFFFFFFF, k, vr.split(" or "), vm, False) for x, k, vr, vm in TAGS]
    return spark.createDataFrame(rows, "tag long, mask long, keyword string, vrs array<string>, vm string, retired boolean")


def dim_transfer_syntax(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFER_SYNTAXES, "ts_uid string, explicit_vr boolean, little_endian boolean, encapsulated boolean, lossy boolean, compression string")


def dim_deid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t(r[0]), *r[1:]) for r in DEID], DEID_SCHEMA)


def dim_dummy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DUMMY, "vr string, dummy string")


def dim_charset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHARSETS, "term string, codec string")


def dim_issue_code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"DICOM-{n:03d}", text) for n, text in ISSUE_CODES], "code string, meaning string")


def dim_command(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMANDS, "field int, command string")


def values_sql(rows: list[tuple]) -> str:
    """Rows as the text of a SQL VALUES list."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
