"""Spark-first selection of photographs from pose detections, with corpus tools in ``sightline.llm``."""
