"""Explicit schemas of the engine's tables and its fixed label dimension."""

from __future__ import annotations

#: Class ids and names; 255 is ignored and 1 to 4 are targets (fixed values).
CLASSES = {0: "background", 1: "cardboard", 2: "soft_plastic", 3: "rigid_plastic", 4: "metal"}
IGNORED = 255
TARGETS = (1, 2, 3, 4)

MANIFEST = (
    "image_id string, split string, file_name string, sequence_id string, frame_index int, variant int, image_path string, mask_path string, width int, height int,"
    " image_sha256 string, mask_sha256 string, n_annotations int, px_background long, px_cardboard long, px_soft_plastic long, px_rigid_plastic long, px_metal long, warnings string"
)
QUARANTINE = "image_id string, split string, file_name string, errors string"
DUPLICATE_PAIRS = (
    "image_id_a string, image_id_b string, split_a string, split_b string, sequence_a string, sequence_b string, frame_gap int, phash_distance int, dhash_distance int, exact boolean, cross_split boolean"
)
SPLITS = "image_id string, official_split string, split string, exclusion_reason string, sequence_id string, frame_index int, unseen_sequence boolean"
ANNOTATIONS = (
    "categories array<struct<id:int,name:string>>, images array<struct<id:long,file_name:string,width:int,height:int>>,"
    " annotations array<struct<id:long,image_id:long,category_id:int,iscrowd:int,segmentation:array<array<double>>>>"
)
