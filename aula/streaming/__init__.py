"""aula.streaming"""
