"""Spark schemas of the relations."""

STAFF_LINES = "doc string, page int, y int, x_start int, x_end int"
STAFF_SYSTEMS = "doc string, page int, system_idx int, lines array<int>, top int, bottom int, center_y int, height int, avg_spacing double"
SEGMENTS = "doc string, page int, system_idx int, x1 int, y1 int, x2 int, y2 int"
BARLINES_RAW = "doc string, page int, system_idx int, x int, y_start int, y_end int"
BARLINES = "doc string, page int, group_idx int, x int, y_start int, y_end int, consensus_count int, group_size int, systems array<int>, type string"
BRACKETS = "doc string, page int, x int, y_start int, y_end int, covered_systems array<int>, raw struct<x1: int, y1: int, x2: int, y2: int>"
MEASURES = "measure_id string, doc string, page int, system_idx int, group_idx int, measure_number int, bbox struct<x: int, y: int, width: int, height: int>, staff_lines array<struct<y: int, original_y: int, staff_index: int, group_index: int>>"
DETECTIONS = "image string, class_id int, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int"
STEMS = DETECTIONS + ", length double, angle double, associated_notehead int"
ANNOTATIONS_JSON = (
    "images array<struct<id: string, filename: string, width: int, height: int>>, "
    "annotations map<string, struct<cat_id: array<string>, img_id: string, a_bbox: array<double>, area: double>>, "
    "categories map<string, struct<name: string>>"
)
YOLO_LABELS = "image string, class_id int, xc double, yc double, w double, h double, conf double"
CLASSES = "id int, name string"
PAGES = "doc string, page int, width int, height int, pixels binary"
