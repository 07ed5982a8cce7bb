"""Schemas of the data model as DDL; sequences carry an explicit ordinal."""

_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
_PAGE_BOX = f"struct<page: int, box: {_BOX}>"

LINES = f"sub_id string, line_id string, ord long, kind string, page int, box {_BOX}, text string, confidence double, engine string"
INK = f"sub_id string, region_id string, page int, box {_BOX}, kind string, ink_ratio double, pixel_count long, covered boolean"
BLOCKS = f"sub_id string, block_id string, ord long, line_ids array<string>, ink_ids array<string>, text string, geometry array<{_PAGE_BOX}>, pages array<int>, cont boolean"
QUESTIONS = "sub_id string, qid string, label_raw string, text string, path array<string>, print_order long, section_id string, marks int, line_ids array<string>, is_stem boolean"
MAPPINGS = "sub_id string, qid string, status string, block_ids array<string>, confidence double"
JUDGED_CHECKS = "sub_id string, qid string, sample int, checks array<struct<index: int, met: boolean, cited_line_ids: array<string>, error: string>>, feedback string, uncertain boolean"
JUDGED_POINTS = "sub_id string, qid string, points array<struct<index: int, marks_awarded: double, satisfied: boolean, cited_line_ids: array<string>, comment: string, error: string>>"
PROGRESS = "sub_id string, seq long, stage string, message string, pages_done int, pages_total int, error string"
GOLDEN = (
    "sample_id string, origin string, question_paper string, answer_sheet string, notes string, questions array<struct<qid: string, label_raw: string, print_order: int, marks: int>>, "
    f"answers array<struct<qid: string, status: string, complete_answer_box: array<{_PAGE_BOX}>, written_lines: array<{_PAGE_BOX}>, text: string>>, lines array<struct<page: int, box: {_BOX}, text: string>>"
)
MARK_SET = (
    "doc_id string, source string, notes string, total_low double, total_high double, questions array<struct<qid: string, label_raw: string, marks_available: double, status: string, "
    "marks_awarded: double, band_low: double, band_high: double, key: string, note: string, excluded_reason: string>>"
)
BLOCKS_JSON = (
    "Blocks array<struct<Id: string, BlockType: string, Text: string, Confidence: double, Page: int, "
    "Geometry: struct<BoundingBox: struct<Left: double, Top: double, Width: double, Height: double>>, Relationships: array<struct<Type: string, Ids: array<string>>>>>"
)
