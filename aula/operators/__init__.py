"""aula.operators"""
