"""Schemas of the tables that the frame operators take and give."""

from __future__ import annotations

#: Spark's image struct; data is row-major BGR (or gray), one byte a channel.
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
FRAMES = f"video_id string, frame_no long, src_frame_no long, image {IMAGE}"
VIDEOS = "video_id string, fps double, frame_count long, frame_interval int"
KEYPOINTS = "image_id string, detector string, kp_id int, x double, y double, size double, circularity double, failed boolean"
LINES = "image_id string, line_id int, x1 int, y1 int, x2 int, y2 int"
ELLIPSES = "image_id string, ord int, cx double, cy double, w double, h double, angle double, area double, points int"
SELECTED = "video_id string, shot_id long, rank int, frame_no long, quality double"
DEBUG_IMAGES = f"image_id string, step_no int, step_name string, image {IMAGE}"
#: The order in which steps of the still-image plan are shown (fixed values).
STEPS = ("Original", "Sharpened", "Blurred", "Canny Edges", "FAST Keypoints", "Detected Features", "Ellipse Comparison", "Final Result", "Cropped Result")
