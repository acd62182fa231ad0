"""Fixed schemas of the domain's tables; nothing is inferred."""

from __future__ import annotations

#: In the form that readers and createDataFrame take.
SCHEMAS: dict[str, str] = {
    "questions": "video_id string, question_id string, question string, options array<string>, answer string, level string, group_type string, second_head string, third_head string",
    "words": "video_id string, ord long, text string, start_time double, end_time double",
    "segments": "video_id string, source string, seg_no int, text string, start double, end double",
    "shots": "video_id string, number int, start_frame int, end_frame int, start double, end double",
    "frame_scores": "video_id string, frame_index int, p float, fps double",
    "keyframes": "video_id string, shot_number int, position int, frame_index int, timestamp double, shot_start double, shot_end double, file_path string",
    "payload": "file_path string, filename string, source_type string, shot_id string, video struct<name:string,filename:string>, shot struct<number:int,position:int,start:double,end:double>, frame struct<index:int,timestamp_seconds:double,timestamp_formatted:string>",
    "points": "id string, siglip array<float>, jina array<float>, payload struct<file_path:string,filename:string,source_type:string,shot_id:string,video:struct<name:string,filename:string>,shot:struct<number:int,position:int,start:double,end:double>,frame:struct<index:int,timestamp_seconds:double,timestamp_formatted:string>>",
    "text_docs": "_id string, channel string, file_path string, video_id string, content string, start double, end double, source string, shot_number int, timestamp double",
    "hits": "query_id long, source string, point_id string, file_path string, shot_id string, video_id string, timestamp double, score double, start double, end double",
    "weights": "config string, source string, weight double",
    "stage_events": "video_id string, stage string, status string, error string, updated_at string, seq long",
    "predictions": "question_id string, config string, pred string, raw string, error string",
    "hashes": "video_id string, shot_number int, position int, h bigint",
    "ocr_results": "file_path string, ocr_result struct<text:string,caption:string>, status string, batch_id int, model_used string, error string",
}
