"""Readers and writers: JSON documents, JSONL manifests, PCM WAV files, artifact trees."""
