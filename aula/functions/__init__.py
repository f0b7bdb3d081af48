"""aula.functions"""
